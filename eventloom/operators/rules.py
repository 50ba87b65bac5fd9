"""Rules as a table: ordered patterns of each source, matched against texts without trying every pattern.

Of each pattern the longest text that any match must hold is found in its syntax tree, in lower case. Its last 2**k characters, as many as fit,
are the rule's anchor. Texts and rules meet by anchors, which is an equi-join: a text asks for those of its own parts of such lengths that a bitmap of
all anchors knows. So neither rules nor texts are held by any task, and ten thousand rules cost about what fits.

Rules that need no certain text are few; they are tried on every text, in slices of at most ``SLICE_BYTES`` of patterns, which one task after the
other holds. What a text's rules give is put together by text, so neither the order nor a table of any size changes the result. Patterns are
Python's, without regard to case.

Defined results: a null text fits nothing and has no tags; rules of a null source hold for all sources; a pattern that isn't one
raises ValueError before any row is read; rules of one ordinal are taken by pattern, those without one last; an empty table of rules gives no tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

SLICE_BYTES = 1 << 20
ANCHORS = (1, 2, 4, 8, 16, 32)  # lengths
MAP_BITS, MOST_MAP_BITS = 16, 26  # a bitmap of anchors has 2**16 to 2**26 bits, at most eight MiB
COMPILED = 1024  # patterns that a task keeps compiled
#: letters that re.IGNORECASE takes for these ASCII ones, though lower() doesn't give them as such
FOLDED = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s"})


def required_text(pattern: str) -> str:
    """The longest text that every match of a pattern holds, in lower case; "" if there is none for certain."""
    best, run = "", ""

    def walk(tree) -> None:
        nonlocal best, run
        for kind, value in tree:
            if kind is C.LITERAL and len(chr(value).lower()) == 1 and chr(value).isascii():
                run += chr(value).lower()
            elif kind is C.SUBPATTERN:
                walk(value[-1])
                continue
            elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
                best, run = max(best, run, key=len), ""
                walk(value[2])
                best, run = max(best, run, key=len), ""
            elif kind is not C.AT:
                best, run = max(best, run, key=len), ""
            if len(run) > len(best):
                best = run

    try:
        walk(_parser.parse(pattern, re.IGNORECASE))
    except re.error as e:
        raise ValueError(f"no pattern: {pattern!r} ({e})") from e
    return max(best, run, key=len)


def folded(text: str) -> str:
    """A text in lower case: where a pattern fits, it holds the pattern's required text."""
    return text.translate(FOLDED).lower()


def anchor_of(need: str) -> str:
    """The last 1, 2, 4 .. 32 characters of a required text, as many as it has."""
    return need[-max(n for n in ANCHORS if n <= len(need)) :]


MUL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def part_keys(texts: list[str], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of anchors up to ``longest``: (text's place, hash) of all parts of the texts with so many bytes. The parts of a
    length are two of half of it, so all texts are hashed at once."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    owner, h = np.repeat(np.arange(len(raw)), sizes), np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) * MUL + MUL
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))  # bytes to the end of the own text
    for n in ANCHORS:
        if n > longest:
            return
        if n > 1:
            half = n // 2
            h = h[: max(0, len(h) - half)] * MUL + h[half:]
            h = (h ^ (h >> np.uint64(29))) * MIX
            h = h ^ (h >> np.uint64(32))
        whole = left[: len(h)] >= n
        yield owner[: len(h)][whole], h[whole] + np.uint64(n)


def key_of(anchor: str) -> int:
    """The hash of an anchor as a signed 64-bit number."""
    return [int(h.view(np.int64)[0]) for _, h in part_keys([anchor], len(anchor))][-1]


class Matcher:
    """The rules of a slice: (source, ordinal, pattern, many, tags)."""

    def __init__(self, rules: list[tuple]):
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}
        held: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, rule in enumerate(rules):
            text = required_text(rule[2])
            if text:
                held.setdefault(text, []).append(i)
            else:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton() if held else None
        if held:
            for text, own in held.items():
                self.automaton.add_word(text, own)
            self.automaton.make_automaton()

    def candidates(self, source, text: str) -> list[int]:
        found = set(self.always)
        if self.automaton is not None:
            for _, own in self.automaton.iter(folded(text)):
                found.update(own)
        return sorted(i for i in found if self.rules[i][0] is None or self.rules[i][0] == source)

    def fitting(self, source, text: str | None) -> list[dict]:
        """Rules that fit: all with a list of tags, and the first of the others."""
        out, single = [], False
        for i in self.candidates(source, text) if text is not None else ():
            _, ordinal, pattern, many, tags = self.rules[i]
            if not many and single:
                continue
            compiled = self.compiled.get(i) or self.compiled.setdefault(i, re.compile(pattern, re.IGNORECASE))
            if compiled.search(text):
                single = single or not many
                out.append({"ordinal": ordinal, "pattern": pattern, "many": many, "tags": tags})
        return out


def _slices(rules: DataFrame) -> Iterator[list[tuple]]:
    """Rules a slice at a time; only a slice is on the driver."""
    held, size = [], 0
    for row in rules.orderBy(F.asc_nulls_last("ordinal"), "pattern").select("source", "ordinal", "pattern", "many", "tags").toLocalIterator():
        if held and size + len(row[2]) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append((row[0], row[1], row[2], row[3], list(row[4] or [])))
        size += len(row[2])
    if held:
        yield held


def _with_needs(rules: DataFrame) -> DataFrame:
    """Rules with ``need`` and its anchor's ``key``, null where there is none, and what is wrong with the pattern."""
    own = rules.where("pattern is not null").select(F.col("source_id").alias("source"), F.col("ordinal").cast("long").alias("ordinal"), "pattern", F.coalesce("many", F.lit(False)).alias("many"), F.col("tags").cast("array<string>").alias("tags"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needs, keys, wrong = [], [], []
            for pattern in batch.column(batch.schema.get_field_index("pattern")).to_pylist():
                try:
                    need, error = required_text(pattern), None
                except ValueError as e:
                    need, error = "", str(e)
                needs.append(need)
                keys.append(key_of(anchor_of(need)) if need else None)
                wrong.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(needs, pa.string()), pa.array(keys, pa.int64()), pa.array(wrong, pa.string())], names=[*batch.schema.names, "need", "key", "wrong"])

    schema = own.select("*", F.lit("").alias("need"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("wrong")).schema
    return own.mapInArrow(told, schema)


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits of the first ``bits`` bits of each key."""
    word = F.shiftrightunsigned("key", 64 - bits + 5).cast("int").alias("word")
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 31 as int))")
    got = keys.groupBy(word).agg(F.bit_or(mask).alias("own")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["word"].to_numpy()] = got["own"].to_numpy().astype(np.uint32)
    return out


def _fitting_slices(asked: DataFrame, rules: DataFrame, schema) -> Iterator[DataFrame]:
    """(id, rule) of the rules without a required text: a pass over the texts for each slice."""
    from pyspark.sql.pandas.types import to_arrow_schema

    for part in _slices(rules):
        shared = asked.sparkSession.sparkContext.broadcast(part)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher, arrow = Matcher(shared.value), to_arrow_schema(schema)
            for batch in batches:
                ids, sources, texts = (batch.column(i).to_pylist() for i in range(3))
                out = [{"id": i, **rule} for i, s, t in zip(ids, sources, texts, strict=True) for rule in matcher.fitting(s, t)]
                yield pa.RecordBatch.from_pylist(out, arrow)

        yield asked.mapInArrow(match, schema)


def _fitting_by_anchor(asked: DataFrame, rules: DataFrame, schema) -> DataFrame | None:
    """(id, rule) of the rules with a required text. Texts meet rules by anchors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    count, longest = rules.agg(F.count_distinct("key"), F.max(F.length("need"))).head()
    if not count:
        return None
    bits = min(MOST_MAP_BITS, max(MAP_BITS, count.bit_length() + 4))
    shared = asked.sparkSession.sparkContext.broadcast(_bitmap(rules.select("key"), bits))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                place, key = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for owner, h in part_keys([folded(t) for t in part.column(2).to_pylist()], longest):
                    at = (h >> np.uint64(64 - bits)).astype(np.int64)
                    hit = (known[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
                    place.append(owner[hit])
                    key.append(h[hit].view(np.int64))
                pairs = np.unique(np.column_stack([np.concatenate(place), np.concatenate(key)]), axis=0)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(pairs[:, 0])) for c in part.columns), pa.array(pairs[:, 1])], names=["id", "own", "text", "key"])

    met = asked.mapInArrow(parts, asked.select("id", F.col("source").alias("own"), "text", F.lit(0).cast("long").alias("key")).schema)
    pairs = met.join(rules, "key").where("source is null or source = own").select("id", "text", "need", "ordinal", "pattern", "many", "tags")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, arrow = {}, to_arrow_schema(schema)
        for batch in batches:
            texts, needs, patterns = (batch.column(i).to_pylist() for i in (1, 2, 4))
            keep = []
            for text, need, pattern in zip(texts, needs, patterns, strict=True):
                if fits := need in folded(text):
                    if (search := compiled.get(pattern)) is None:
                        if len(compiled) >= COMPILED:
                            compiled.clear()
                            re.purge()
                        search = compiled[pattern] = re.compile(pattern, re.IGNORECASE).search
                    fits = search(text) is not None
                keep.append(fits)
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(i).cast(f.type) for i, f in zip((0, 3, 4, 5, 6), arrow, strict=True)], schema=arrow)

    return pairs.mapInArrow(fit, schema)


def routed(rows: DataFrame, rules: DataFrame, text: str = "text", source: str = "source_id") -> DataFrame:
    """``rows`` with ``tags``: of the fitting rules (source_id, ordinal, pattern, many, tags) those with a list give the union of their lists; if there is
    none, the first other one gives its tags. Equal texts of a source are asked once."""
    none, rows = F.array().cast("array<string>"), rows.drop("tags")
    known = written(_with_needs(rules), "rules")
    if (bad := known.where("wrong is not null").select("wrong").head()) is not None:
        raise ValueError(bad[0])
    asked = rows.select(F.col(source).alias("source"), F.col(text).alias("text")).where("text is not null").distinct()
    asked = written(asked.select(F.monotonically_increasing_id().alias("id"), "source", "text"), "rule-texts")
    schema = asked.select("id", *(F.lit(None).cast(k).alias(c) for c, k in (("ordinal", "long"), ("pattern", "string"), ("many", "boolean"), ("tags", "array<string>")))).schema
    for f in schema:
        f.nullable = True
    parts = [*_fitting_slices(asked, known.where("key is null"), schema), _fitting_by_anchor(asked, known.where("key is not null"), schema)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return rows.withColumn("tags", none)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    rule = F.struct(F.col("ordinal").isNull().alias("last"), "ordinal", "pattern", F.coalesce("tags", none).alias("tags"))
    told = found.groupBy("id").agg(F.collect_list(F.when(F.col("many"), rule)).alias("lists"), F.min(F.when(~F.col("many"), rule)).alias("single"))
    lists = F.flatten(F.transform(F.array_sort("lists"), lambda r: r["tags"]))
    told = told.select("id", F.when(F.size("lists") > 0, F.array_distinct(lists)).otherwise(F.col("single.tags")).alias("tags"))
    told = asked.join(told, "id").select(F.col("source").alias("_source"), F.col("text").alias("_text"), "tags")
    same = F.col(source).eqNullSafe(F.col("_source")) & (F.col(text) == F.col("_text"))
    return rows.join(told, same, "left").drop("_source", "_text").withColumn("tags", F.coalesce("tags", none))
