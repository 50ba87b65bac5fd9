from datetime import date

from pyspark.sql import functions as F

from eventloom.functions import phrases

CASES = [
    ("18th March 2026", "2026-01-01", True, False, "2026-03-18"), ("Saturday 21st of February 2026", "2026-01-01", True, False, "2026-02-21"), ("21/02/2026", "2026-01-01", True, False, "2026-02-21"), ("25 February", "2026-06-15", True, False, "2026-02-25"),
    ("March 14, 2026", "2026-01-01", False, False, "2026-03-14"), ("January 29th, 2026", "2026-01-01", False, False, "2026-01-29"), ("2026-02-15T14:00:00-06:00", "2026-01-01", False, False, "2026-02-15"), ("03/04/2026", "2026-01-01", False, False, "2026-03-04"), ("03/04/2026", "2026-01-01", True, False, "2026-04-03"),
    ("", "2026-01-01", False, False, None), ("no date here at all", "2026-01-01", False, False, None), ("5th January", "2026-12-15", True, True, "2027-01-05"), ("5th March", "2026-06-15", True, False, "2026-03-05"), ("2/12/2026", "2026-01-01", False, False, "2026-02-12"), ("Thursday, 2/12/2026", "2026-01-01", False, False, "2026-02-12"),
    ("Dec 25 2025", "2026-01-01", False, False, "2025-12-25"), ("Feb 19th", "2026-01-01", False, False, "2026-02-19"), ("3-7", "2026-01-01", False, False, "2026-03-07"), ("10-31", "2026-01-01", False, False, "2025-10-31"), ("10-31", "2026-01-01", False, True, "2026-10-31"), ("3-7", "2026-12-15", False, True, "2027-03-07"),
    ("3-7-26", "2026-01-01", False, False, "2026-03-07"), ("5 May 49", "2026-01-01", True, False, "2049-05-05"), ("5 May 50", "2026-01-01", True, False, "1950-05-05"), ("31 Apr 26", "2026-01-01", True, False, None), ("5 Xyz 26", "2026-01-01", True, False, None), ("5-May-26", "2026-01-01", True, False, "2026-05-05"),
    ("Sept 3", "2026-08-01", False, False, "2026-09-03"), ("yesterday", "2026-03-01", False, False, "2026-02-28"), ("an update in a week", "2026-03-01", False, False, "2026-03-08"), ("two months later", "2025-12-31", False, False, "2026-02-28"), ("last year", "2024-02-29", False, False, "2023-02-28"),
    ("next Sunday", "2026-05-06", False, False, "2026-05-17"), ("next Monday", "2026-05-10", False, False, "2026-05-11"), ("next Sunday", "2026-05-09", False, False, "2026-05-17"), ("13/13/2026", "2026-05-09", False, False, None), ("meet 7:30 on 12.06.2026", "2026-05-09", True, False, "2026-06-12"), ("x" * 10_000, "2026-05-09", True, False, None), (None, "2026-05-09", True, False, None), ("5 May", None, True, False, None),
]


def test_phrases(spark):
    rows = [(i, t, None if r is None else date.fromisoformat(r), d, f) for i, (t, r, d, f, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string, r date, d boolean, f boolean")
    got = dict(df.select("i", phrases.spoken_date(F.col("t"), F.col("r"), F.col("d"), F.col("f")).cast("string").alias("x")).collect())
    assert {CASES[i]: x for i, x in got.items() if x != CASES[i][-1]} == {}
