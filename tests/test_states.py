import json

import pytest
from pyspark.sql import functions as F

from eventloom.sources import states


@pytest.mark.parametrize("text, expected", [
    (None, []), ("", []), ("no marker {}", []), ('x: {"n":1,"venue":{"name":"x"}}', ['{"n":1,"venue":{"name":"x"}}']), ('x={"a":"}\\"{"} x = [1,[2]]', ['{"a":"}\\"{"}', "[1,[2]]"]),
    ('x:{"open":{ x:{"n":2}', ['{"n":2}']), ("x: no", []), ('x:{"open" x:[3]', ["[3]"]), ('x:{"in":"x:{1}"}', ['{"in":"x:{1}"}']),
])
def test_brackets_are_balanced(text, expected):
    assert states.blobs(text, "x") == expected


def page(*pairs):
    return "STATE = " + json.dumps({"s": dict(pairs)}) + ";"


def test_links_of_several_hops(spark):
    rows = [
        (1, page(("E:1", {"t": "a", "venue": {"__ref": "V:1"}}), ("V:1", {"n": "bar", "city": {"__ref": "C:1"}}), ("C:1", {"n": "town", "land": {"__ref": "L:1"}}), ("L:1", {"n": "land"}))),
        (2, page(("E:1", {"t": "b", "venue": {"__ref": "V:1"}}), ("V:1", {"n": "other", "city": {"n": "inline"}}))),  # the same ids on another page
        (3, page(("E:1", {"t": "c", "venue": {"__ref": "E:1"}}))),  # a link to itself
        (4, page(("E:1", {"t": "d", "venue": {"__ref": "V:9"}}), ("E:2", {"t": "e", "venue": None}), ("E:3", {"t": "f"}), ("x", 7))),
        (5, None), (6, "STATE = {broken}"), (7, 'STATE = {"s":[]}'),
    ]
    docs = states.documents(spark.createDataFrame(rows, "page int, html string"), "page", "html", "STATE")
    nodes = states.nodes(docs, "page", "$.s")
    found = states.followed(nodes.where(F.col("node_id").startswith("E:")), nodes, "page", ["venue", "city", "land"])
    name = lambda c: states.field(c, "n").alias(f"{c}_n")
    got = {(r.page, r.t): (r.venue_n, r.city_n, r.land_n) for r in found.select("page", states.field("node", "t").alias("t"), name("venue"), name("city"), name("land")).collect()}
    assert got == {(1, "a"): ("bar", "town", "land"), (2, "b"): ("other", "inline", None), (3, "c"): (None, None, None), (4, "d"): (None, None, None), (4, "e"): (None, None, None), (4, "f"): (None, None, None)}


def test_fields_of_another_kind_are_null(spark):
    doc = spark.range(1).select(F.parse_json(F.lit('{"n":"seven","m":7,"o":{"p":true}}')).alias("d"))
    assert tuple(doc.select(states.field("d", "n", "int"), states.field("d", "m", "int"), states.field("d", "o.p", "boolean"), states.field("d", "none")).head()) == (None, 7, True, None)
