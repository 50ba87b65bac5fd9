"""Row fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLEARED = "\x00null"


def tri_state(value: Column, name: str, cleared: Column | None) -> Column:
    """Token of a field that may be absent (empty), cleared on purpose (a marker) or set."""
    plain = F.coalesce(value.cast("string"), F.lit(""))
    return plain if cleared is None else F.when(F.array_contains(cleared, name), F.lit(CLEARED)).otherwise(plain)


def fingerprint(date: Column, tags: Column, fields: Sequence[tuple[str, Column]], gated: Sequence[tuple[str, Column]] = (), cleared: Column | None = None) -> Column:
    """SHA-256 over the date, the sorted distinct tags and the fields in their order. Gated fields add a token
    only where they are set or cleared, so rows without them keep their fingerprints."""
    tokens = [F.date_format(date, "yyyy-MM-dd"), F.array_join(F.array_sort(F.array_distinct(tags)), ","), *(tri_state(c, n, cleared) for n, c in fields)]
    for n, c in gated:
        own = F.concat(F.lit(f"{n}="), tri_state(c, n, cleared))
        present = c.isNotNull() if cleared is None else c.isNotNull() | F.array_contains(cleared, n)
        tokens.append(F.when(F.coalesce(present, F.lit(False)), own))  # concat_ws leaves nulls out
    return F.sha2(F.concat_ws("|", *tokens), 256)


def content_hash(*columns: Column) -> Column:
    """SHA-256 of parts, one to a line, nulls as empty lines."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def config_hash(text: Column) -> Column:
    """SHA-256 of a JSON text in one form: keys in order at every level, no blanks; "null" for null. A malformed text has none."""

    def run(texts: pd.Series) -> pd.Series:
        def canonical(t):
            return "null" if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

        def digest(t):
            try:
                return hashlib.sha256(canonical(t).encode("utf-8", "surrogatepass")).hexdigest()
            except (ValueError, RecursionError):
                return None

        return pd.Series([digest(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


class _Outline(HTMLParser):
    """Tags with their classes, nested; texts, attributes and repeats of one sibling don't count."""

    VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

    def __init__(self):
        super().__init__()
        self.parts, self.open = [], []

    def handle_starttag(self, tag, attrs):
        name = tag + "".join(f".{c}" for c in sorted((dict(attrs).get("class") or "").split()))
        line = f"{len(self.open)}:{name}"
        if not self.parts or self.parts[-1] != line:
            self.parts.append(line)
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass


def outline_hash(page: str) -> str:
    outline = _Outline()
    outline.feed(page)
    return hashlib.sha256("\n".join(outline.parts).encode("utf-8")).hexdigest()


def structure_hash(html: Column) -> Column:
    """SHA-256 of a page's outline of tags and classes: it changes with the template, not with texts."""

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([outline_hash(page or "") for page in pages])

    return F.pandas_udf(run, "string")(html)
