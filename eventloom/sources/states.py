"""JSON that pages carry: objects behind a marker, as VARIANT, and the references between the nodes of a page's state.

Null texts and texts without the marker have no objects. An object that isn't closed, and one that is no JSON, is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = "__ref"


def balanced(text: str, at: int) -> int:
    """The end of the object or array that starts at ``at``; -1 if it is never closed. Brackets within strings don't count."""
    depth, quoted, n = 0, False, len(text)
    while at < n:
        c = text[at]
        if quoted:
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def blobs(text: str | None, marker: str) -> list[str]:
    out, at = [], 0
    while text and (at := text.find(marker, at)) >= 0:
        at += len(marker)
        start = at
        while start < len(text) and text[start] in " \t\r\n=:":
            start += 1
        if text[start : start + 1] in ("{", "["):
            end = balanced(text, start)
            if end < 0:  # a later marker may still be whole
                continue
            out.append(text[start:end])
            at = end
    return out


def marked_blobs(html: Column, marker: str) -> Column:
    """JSON objects and arrays that follow a marker in a page (blanks, "=" and ":" between), as an array of texts; nested ones are whole."""

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([blobs(page, marker) for page in pages])

    return F.pandas_udf(run, "array<string>")(html)


def documents(pages: DataFrame, key: str, html: str, marker: str) -> DataFrame:
    """A row (key, at, document) for each marked object of a page, as VARIANT."""
    rows = pages.select(key, F.posexplode(marked_blobs(F.col(html), marker)).alias("at", "_json"))
    return rows.select(key, "at", F.try_parse_json("_json").alias("document")).where("document is not null")


def nodes(documents: DataFrame, key: str, path: str = "$") -> DataFrame:
    """Nodes (key, node_id, node) of a state: the fields of the object at ``path`` of each document."""
    held = documents.select(F.col(key).alias("_page"), F.try_variant_get("document", path, "variant").alias("_state")).where("_state is not null")
    exploded = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("_state").outer())).where("key is not null")
    return exploded.select(F.col("_page").alias(key), F.col("key").alias("node_id"), F.col("value").alias("node"))


def followed(start: DataFrame, nodes: DataFrame, key: str, hops: Sequence[str]) -> DataFrame:
    """Rows (key, node_id, node) of ``start`` with a column for each of the ``hops``: the node that the field of the one before refers to on the
    same page, or the object that stands there itself; null where a link leads nowhere. Each hop is a join by (page, reference)."""
    out, at = start, "node"
    for hop in hops:
        target = nodes.select(F.col(key).alias("_page"), F.col("node_id").alias("_id"), F.col("node").alias("_target"))
        own = F.try_variant_get(at, f"$.{hop}", "variant")
        out = out.withColumn("_ref", F.try_variant_get(at, f"$.{hop}.{REFERENCE}", "string"))
        out = out.join(target, (F.col(key) == F.col("_page")) & (F.col("_ref") == F.col("_id")), "left")
        out = out.withColumn(hop, F.when(F.col("_ref").isNotNull(), F.col("_target")).otherwise(own)).drop("_ref", "_page", "_id", "_target")
        at = hop
    return out


def field(node: Column | str, path: str, kind: str = "string") -> Column:
    """A field of a VARIANT, null where it is absent or of another kind."""
    return F.try_variant_get(node, f"$.{path}", kind)
