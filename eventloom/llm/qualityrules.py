"""Quality rules: text statistics, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hash buckets of word and punctuation n-grams: that of
trusted target documents and that of the whole raw corpus. A document's score is the mean
of ``log p_target / p_raw`` over its n-grams, and it is kept if the score reaches a fixed threshold.
Everything is DataFrame functions: no Python runs on the executors.

The target model counts every n-gram of every trusted document, the raw model those of every document. Trusted ids
meet the documents in a shuffled join, which moves each text once.

Defined results: a null or empty text has zero in every count, fails the base rules and scores 0;
rows that repeat a doc_id are documents of their own, each with the verdict of its text; without any
trusted document all ratios are 0 and the base rules decide; an empty table gives no rows;
columns of the documents pass through :func:`quality_columns` unless they bear its own names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

SPACE = r"[\x20\x09-\x0D]+"
TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
BUCKETS = 1 << 14
SMOOTHING = 0.5
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once for each row and names it in ``body``. A projection below
    would be merged by the optimizer, and ``value`` evaluated again for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _repeat_words(words: str) -> str:
    """SQL: words in 3-word windows that occur twice or more. Each window is coded as its hash above
    its position; after sorting, equal windows are neighbours, and their words are compared,
    so a chance collision of hashes counts nothing."""

    def equal(x: str, y: str) -> str:
        # windows that would pass the end have null words and equal nothing
        same = " AND ".join(f"get({words}, cast({x} & low as int) + {k}) = get({words}, cast({y} & low as int) + {k})" for k in range(3))
        return f"coalesce(({x} ^ {y}) BETWEEN 0 AND low AND {same}, false)"

    codes = f"sort_array(transform({words}, (w, i) -> (xxhash64(w, get({words}, i + 1), get({words}, i + 2)) & ~low) | i))"
    marked = f"filter(codes, (v, k) -> {equal('v', 'get(codes, k - 1)')} OR {equal('v', 'get(codes, k + 1)')})"
    spread = f"flatten(transform({marked}, v -> array(cast(v & low as int), cast(v & low as int) + 1, cast(v & low as int) + 2)))"
    low = f"shiftleft(1L, cast(ceil(log2(size({words}) + 1)) as int)) - 1"
    return _let(low, "low", _let(codes, "codes", f"cast(size(array_distinct({spread})) as bigint)"))


def base_columns(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the contract's counts and base_failed."""
    text = f"coalesce({text_col}, '')"
    words = f"filter(split({text}, r'{SPACE}'), w -> w <> '')"
    lines = f"filter(split({text}, r'\n'), x -> x rlike r'[^\x20\x09-\x0D]')"
    counts = f"named_struct('n_words', cast(size(ws) as bigint), 'word_chars', cast(length(array_join(ws, '')) as bigint), 'n_repeat_words', {_repeat_words('ws')})"
    own = free_name([*documents.columns, *RESULTS], "_q")
    df = documents.withColumn(own, F.expr(_let(words, "ws", counts)))
    df = df.withColumns({
        "n_words": F.col(f"{own}.n_words"),
        "word_chars": F.col(f"{own}.word_chars"),
        "n_symbols": F.expr(f"cast(regexp_count({text}, r'[#*$%&|<>]') as bigint)"),
        "n_dup_lines": F.expr(_let(lines, "ls", "cast(size(ls) - size(array_distinct(ls)) as bigint)")),
        "n_repeat_words": F.col(f"{own}.n_repeat_words"),
    }).drop(own)
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _grams(n: int) -> str:
    if n == 1:
        return f"transform(ts, t -> cast(xxhash64(t) & {BUCKETS - 1} as int))"
    following = ", ".join(f"get(ts, i + {k})" for k in range(1, n))
    return f"transform(slice(ts, 1, greatest(size(ts) - {n - 1}, 0)), (t, i) -> cast(xxhash64(t, {following}) & {BUCKETS - 1} as int))"


def buckets(orders: tuple[int, ...], text_col: str = "text") -> str:
    """SQL: buckets of all n-grams of a text, in order of n and place."""
    return _let(f"regexp_extract_all(lower(coalesce({text_col}, '')), r'{TOKENS}', 0)", "ts", f"concat({', '.join(map(_grams, orders))})")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents rated good and not toxic."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 and coalesce(x, 0) = 0 and doc_id is not null")
    return good.select("doc_id")


def bucket_ratios(documents: DataFrame, labels: DataFrame, orders: tuple[int, ...] = (1, 2), text_col: str = "text") -> list[float]:
    """``log p_target / p_raw`` for each bucket. Counts meet as 2**14 sums at any input size."""
    # ids grow with the corpus, so they are joined by a shuffle at every size; documents without an id are dealt out by text
    trusted = trusted_ids(labels).select("doc_id", F.lit(0).cast("long").alias("deal"), F.lit(1).alias("trusted")).hint("merge")
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    rows = documents.select("doc_id", F.col(text_col).alias("text")).withColumn("deal", deal).join(trusted, ["doc_id", "deal"], "left")
    grams = rows.select("trusted", F.explode(F.expr(buckets(orders))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target")).collect()
    raw, target = {r["bucket"]: r["raw"] for r in counts}, {r["bucket"]: r["target"] for r in counts}
    n_raw, n_target = sum(raw.values()), sum(target.values())
    if not n_target:
        return [0.0] * BUCKETS
    floor = SMOOTHING * BUCKETS
    return [log((target.get(b, 0) + SMOOTHING) / (n_target + floor)) - log((raw.get(b, 0) + SMOOTHING) / (n_raw + floor)) for b in range(BUCKETS)]


def quality_columns(documents: DataFrame, labels: DataFrame, threshold: float = -0.25, orders: tuple[int, ...] = (1, 2), text_col: str = "text") -> DataFrame:
    """``documents`` with the counts, base_failed, llr and kept."""
    ratios = bucket_ratios(documents, labels, orders, text_col)
    # 2**14 numbers as one constant, which the optimizer folds to an array
    lookup = f"from_json('[{','.join(f'{r:.6f}' for r in ratios)}]', 'array<double>')"
    df = base_columns(documents.drop(*RESULTS), text_col)
    mean = _let(buckets(orders, text_col), "bs", f"try_divide(aggregate(bs, 0D, (a, b) -> a + get({lookup}, b)), size(bs))")
    df = df.withColumn("llr", F.expr(f"coalesce({mean}, 0D)"))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
