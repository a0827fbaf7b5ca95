"""The catalogue against its SQL, the entry point, and live streams."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinetrace.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_smooth_series_filters_every_stream(spark, sf_dir):
    from kinetrace.operators.smooth import zero_phase

    got, want = {}, {}
    for x in __spark_entry__.queries()["smooth_series"](spark, sf_dir).collect():
        got[x.event_id] = x.value
    streams = {}
    for x in catalogue.readings(spark, sf_dir).collect():
        streams.setdefault((x.episode, x.stream), []).append((x.t, x.event_id, x.value))
    for own in streams.values():
        own.sort()
        want |= zip((e for _, e, _ in own), zero_phase([[v] for *_, v in own], 5.0)[:, 0])
    assert got.keys() == want.keys() and all(abs(got[e] - v) < 1e-9 for e, v in want.items())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["success_only"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]


def test_hot_stream_in_slices(spark, sf_dir):
    """Predecessors found in slices of time are those of one window over the stream."""
    from kinetrace.operators import align

    r = catalogue.readings(spark, sf_dir)
    whole = align.previous(r, ["episode", "stream"], "t", ["event_id"])
    cut = align.previous(r, ["episode", "stream"], "t", ["event_id"], 7 * 86_400e6)
    assert rows(["e", "p"], whole.select("event_id", "previous").collect()) == rows(["e", "p"], cut.select("event_id", "previous").collect())


def test_slices_are_chosen_by_the_fullest_stream(spark, sf_dir, monkeypatch):
    from kinetrace.operators import align

    r = catalogue.readings(spark, sf_dir)
    g = align.with_grid(align.common_range(r, "episode", "stream", "t"), catalogue.STEP)
    assert align.slice_width(r, ["episode", "stream"], "t") is None
    whole = align.forward_asof(r, g, "episode", "stream", "t", ["event_id"]).collect()
    monkeypatch.setattr(align, "ONE_TASK", 0)
    assert align.slice_width(r, ["episode", "stream"], "t") is None
    monkeypatch.setattr(align, "SLICE_ROWS", 5)
    assert align.slice_width(r, ["episode", "stream"], "t") > 0
    assert Counter(align.forward_asof(r, g, "episode", "stream", "t", ["event_id"]).collect()) == Counter(whole)


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_by_rank_are_those_of_buffers(spark, monkeypatch, keys, accuracy):
    """Groups too large for a buffer, with a hot one, ties, nulls and NaN; sketched brackets and whole ones."""
    import numpy as np

    from kinetrace.operators import stats

    r = np.random.default_rng(1)
    n = 24_000
    x = np.where(r.random(n) < 0.3, 5.0, r.normal(0, 10, n)).round(2)
    rows = [(int(g), int(h) or None, None if i % 50 == 0 else float("nan") if i % 50 == 1 else float(v)) for i, (g, h, v) in enumerate(zip(r.random(n) < 0.05, r.integers(0, 3, n), x))]
    df = spark.createDataFrame([*rows, (7, 7, None), (8, None, 1.0), (8, None, 2.0)], "g int, h int, v double").repartition(4)
    want = stats.describe(df, "v", *keys).collect()
    monkeypatch.setattr(stats, "HELD", 500)
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    got = stats.describe(df, "v", *keys).collect()
    assert rows_(got) == rows_(want)


def rows_(found):
    return Counter(tuple(norm(v) for v in r) for r in found)


def test_numbering_in_spans(spark):
    """Positions numbered span by span, with gaps and negative ones, against one window over all."""
    from kinetrace.operators import episodes

    rows = [(d, p, (p * 7) % 5) for d in (2, 0) for p in [*range(-9, 40), 100, 101, 5000]]
    df = spark.createDataFrame(rows, "d int, p bigint, n bigint").repartition(3)
    got = {(r.d, r.p): (r.rows_before, r.total_before) for r in episodes.running(df, ["d", "p"], F.col("n"), span=8).collect()}
    total = 0
    for k, (d, p, n) in enumerate(sorted(rows)):
        assert got[d, p] == (k, total)
        total += n


def test_live_alignment_equals_the_batch(spark, sf_dir, tmp_path):
    from kinetrace.streaming import live

    r = catalogue.readings(spark, sf_dir).select("episode", "stream", "t", "value")
    least = r.agg(F.min("t")).first()[0]
    low = r.agg(F.percentile_approx("t", 0.5)).first()[0]
    for part in (r.where(F.col("t") <= low), r.where(F.col("t") > low)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    step = 30 * 86_400_000_000
    q = live.aligned_stream(source, "episode", "stream", "t", "value", least, step).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = Counter(tuple(x) for x in spark.table("live").collect())
    want = Counter()
    for (e, s), times in _by_stream(r).items():
        k = 0
        for t, v in sorted(times):
            while least + k * step <= t:
                want[e, s, k, t, v] += 1
                k += 1
    assert got == want


def _by_stream(r):
    out = {}
    for x in r.collect():
        out.setdefault((x.episode, x.stream), []).append((x.t, x.value))
    return out
