from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from headwise.functions import keys, predicates, stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def textbook_wilson(s, n, z=1.96):
    p = s / n
    d = 1 + z * z / n
    c = (p + z * z / (2 * n)) / d
    h = z / d * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return 100 * (c - h), 100 * (c + h)


def test_wilson(spark):
    pairs = [(s, n) for n in (1, 3, 4, 20, 400, 10**6) for s in {0, 1, n // 3, n}]
    df = spark.createDataFrame([(0, 0), *pairs], "s int, n int")
    rows = df.select("s", "n", stats.wilson(F.col("s"), F.col("n")).alias("w")).collect()
    for r in rows:
        if r.n == 0:
            assert (r.w.lo, r.w.hi) == (0.0, 100.0)
            continue
        lo, hi = textbook_wilson(r.s, r.n)
        assert r.w.lo == pytest.approx(max(0, lo), abs=1e-9)
        assert r.w.hi == pytest.approx(min(100, hi), abs=1e-9)
        assert r.w.lo <= 100 * r.s / r.n + 1e-9 <= r.w.hi + 2e-9
    by = {(r.s, r.n): r.w for r in rows}
    assert by[1, 4].lo < 10 and by[1, 4].hi > 60
    assert by[3, 3].lo < 60


def test_population_sd_is_exact_for_large_values(spark):
    # Three values near 7000, repeated: the naive difference of squares loses digits.
    n, values = 3 * 10**9, (6999, 7000, 7001)
    total, total_sq = 10**9 * sum(values), 10**9 * sum(v * v for v in values)
    got = value(spark, stats.population_sd(F.lit(n), F.lit(total), F.lit(total_sq)))
    assert got == pytest.approx(math.sqrt(2 / 3), rel=1e-12)
    assert value(spark, stats.population_sd(F.lit(4), F.lit(28), F.lit(196))) == 0.0
    assert value(spark, stats.population_sd(F.lit(0), F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize(("n", "label"), [(4, "sparse"), (5, "provisional"), (19, "provisional"), (20, "confident")])
def test_confidence(spark, n, label):
    assert value(spark, stats.confidence(F.lit(n))) == label


@pytest.mark.parametrize(
    ("seconds", "phrase"),
    [(44, "about on time"), (-44, "about on time"), (45, "0.8 min late"), (150, "2.5 min late"), (-90, "1.5 min early"),
     (90000, "1500.0 min late")],
)
def test_delay_phrase(spark, seconds, phrase):
    assert value(spark, stats.delay_phrase(F.lit(seconds))) == phrase


def test_coverage_class(spark):
    none = F.lit(None).cast("string")
    assert value(spark, stats.coverage_class(F.lit(84.9), none)) == "unexplained"
    assert value(spark, stats.coverage_class(F.lit(85.0), none)) == "none"
    assert value(spark, stats.coverage_class(F.lit(10.0), F.lit("storm"))) == "known_gap"


def test_mean_band(spark):
    one = value(spark, stats.mean_band(F.lit(1), F.lit(7.0), F.lit(3.0)))
    assert (one.lo, one.hi) == (7.0, 7.0)
    four = value(spark, stats.mean_band(F.lit(4), F.lit(7.0), F.lit(3.0)))
    assert four.lo == pytest.approx(7 - 1.96 * 1.5) and four.hi == pytest.approx(7 + 1.96 * 1.5)


@pytest.mark.parametrize(
    ("source", "rel", "delay", "counts"),
    [(1, 0, 0, True), (1, 0, 7199, True), (1, 0, -7199, True), (1, 0, 7200, False), (1, 0, None, False),
     (2, 0, 5, False), (0, 0, 5, False), (1, 1, 5, False), (None, 0, 5, False)],
)
def test_countable(spark, source, rel, delay, counts):
    cols = [F.lit(x).cast("int") for x in (source, rel, delay)]
    assert value(spark, predicates.is_countable(*cols)) is counts
    predicates.register_sql(spark)
    args = ", ".join("NULL" if x is None else str(x) for x in (source, rel, delay))
    assert spark.sql(f"select observation_is_countable({args}) as x").first().x is counts


@pytest.mark.parametrize(
    ("text", "code"),
    [(None, 0), ("SCHEDULED", 0), ("SKIPPED", 1), ("NO_DATA", 2), ("UNSCHEDULED", 3), ("2", 2), ("9", 9), ("odd", 0)],
)
def test_relationship_code(spark, text, code):
    assert value(spark, predicates.relationship_code(F.lit(text).cast("string"))) == code


def test_skip_reason(spark):
    none = F.lit(None).cast("long")
    arr = F.lit(5)
    assert value(spark, predicates.skip_reason(F.lit(2), arr, arr)) == "no_data"
    assert value(spark, predicates.skip_reason(F.lit(0), none, arr)) == "departure_only"
    assert value(spark, predicates.skip_reason(F.lit(0), none, none)) == "no_time"
    assert value(spark, predicates.skip_reason(F.lit(1), arr, none)) is None


@pytest.mark.parametrize(
    ("path", "key"),
    [
        ("trips/2026-09-16/2026-09-16T17.ndjson.gz", "trips/2026/09/16/17.ndjson.gz"),
        ("alerts/2026-01-01/2026-01-01T00.ndjson.br", "alerts/2026/01/01/00.ndjson.br"),
        ("trips/2026-09-16/2026-09-16T17.ndjson.gz.partial", None),
        ("trips/2026-09-16/notashard.txt", None),
        ("2026-09-16T17.ndjson.gz", None),
        ("a/b/c/d/2026-09-16T17.ndjson.gz", None),
        ("../2026-09-16/2026-09-16T17.ndjson.gz", None),
        ("", None),
    ],
)
def test_shard_key(spark, path, key):
    assert value(spark, keys.shard_key(F.lit(path))) == key
