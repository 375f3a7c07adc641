import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import build, evaluate, workload
from tidemark.sources import streams
from tidemark.sources.config import Config

SPEC = """
decay-functions = ["exponential2", "rationalPower1,1,2,1"]
operators = ["SimpleCountOperator", "CMSOperator5,1000"]
ingest-buffer-size = 62
[streams]
nstreams = 2
[data]
tstart = 100
tend = 5000
interarrivals = {distribution = "ExponentialDistribution", lambda = 0.5}
values = {distribution = "UniformDistribution", min = 1, max = 100}
tag-landmarks = {threshold = 99}
[workload]
ticks-per-second = 10
"""
ROWS = "stream_id long, ts long, value long"


def series(seed, n=400):
    rng, t, out = random.Random(seed), 5, []
    for _ in range(n):
        t += rng.choice([1, 1, 2, 300])
        out.append((seed, t, rng.choice([1, 2, 3, 50])))
    return out


def test_slices_change_nothing(spark, monkeypatch):
    """A stream in many slices, some of them empty, gives what one pass over it gives."""
    rows = series(1) + series(2) + [(3, 7, 50)]
    monkeypatch.setattr(build, "SLICE_ELEMENTS", 7)
    e = spark.createDataFrame(rows, ROWS).repartition(5)
    stats = {r.stream_id: r for r in build.stream_stats(e).collect()}
    got = {}
    for r in build.landmark_windows(e, 50).collect():
        got.setdefault(r.stream_id, []).append((r.ts, r.te, r.n_values, r.sum_values))
    marked = {(r.stream_id, r.ts) for r in build.deviation_landmarks(e, 2.0).filter("is_landmark").collect()}
    for s in (1, 2, 3):
        own = [x for x in rows if x[0] == s]
        gaps = [b[1] - a[1] for a, b in zip(own, own[1:])]
        assert stats[s].n == len(own) and abs(stats[s].gap_mean - (statistics.mean(gaps) if gaps else 0)) < 1e-9
        assert abs(stats[s].gap_sd - (statistics.stdev(gaps) if len(gaps) > 1 else 0)) < 1e-9
        runs, k = [], 0
        while k < len(own):
            j = k
            while j < len(own) and own[j][2] >= 50:
                j += 1
            if j > k:
                runs.append((own[k - 1][1] + 1 if k else own[0][1], own[j][1] - 1 if j < len(own) else None, j - k, 50 * (j - k)))
            k = max(j, k + 1)
        assert sorted(got.get(s, [])) == runs
        values = [x[2] for x in own]
        want = {(s, own[k][1]) for k in range(2, len(own)) if abs(values[k] - statistics.mean(values[:k])) > 2 * statistics.stdev(values[:k])}
        assert {x for x in marked if x[0] == s} == want


def test_operations(spark, monkeypatch):
    monkeypatch.setattr(build, "SLICE_ELEMENTS", 3)
    ops = [("APPEND", 1, 10), ("LANDMARK_END", 2, None), ("LANDMARK_START", 4, None), ("APPEND", 4, 11), ("LANDMARK_START", 6, None), ("APPEND", 700, 12), ("APPEND", 800, 13), ("LANDMARK_END", 800, None), ("APPEND", 801, 14), ("LANDMARK_START", 900, None), ("APPEND", 901, 15)]
    frame = spark.createDataFrame([(s, *o) for s in (0, 1) for o in ops], "stream_id long, op string, ts long, value long")
    elements, windows = streams.from_operations(frame)
    want = [(1, 10, False), (4, 11, True), (700, 12, True), (800, 13, True), (801, 14, False), (901, 15, True)]
    assert sorted(map(tuple, elements.collect())) == [(s, *x) for s in (0, 1) for x in want]
    assert sorted(map(tuple, windows.filter("stream_id = 1").collect())) == [(1, 4, 800), (1, 900, None)]
    with pytest.raises(Exception, match="unknown operation"):
        streams.from_operations(spark.createDataFrame([(0, "DELETE", 1, 1)], frame.schema))[0].collect()
    assert streams.from_operations(frame.limit(0))[0].count() == 0


def test_mixtures_and_quantiles(spark):
    a = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v long")
    b = spark.createDataFrame([(x,) for x in (7, 8)], "v long")
    h = [(evaluate.histogram_cdf(x, "v", 0, 10, 10), w) for x, w in ((a, 1), (b, 3))]
    cdf = {r.bin: r.cdf for r in evaluate.mixture_cdf(h).collect()}
    assert cdf[0] == 0 and cdf[4] == 0.25 and cdf[7] == 0.625 and cdf[9] == 1
    assert evaluate.cdf_quantile(h[0][0], 0.5).first().quantile == 3 and evaluate.cdf_quantile(h[0][0], 0.6).first().quantile == 3.5
    s = evaluate.mixture_stats([(evaluate.observation_stats(x, "v"), w) for x, w in ((a, 1), (b, 1))]).first()
    assert (s.n, s.mean, s.low, s.high) == (6, 5.0, 1, 8)


def test_workloads(spark):
    assert [tuple(r) for r in workload.forward_bins(spark, 5, 29, 10).collect()] == [(0, 5, 15), (1, 15, 25)]
    assert workload.forward_bins(spark, 5, 6, 10).count() == 0
    base = spark.createDataFrame([(1, 0, 9)], "qid long, l long, r long")
    values = spark.createDataFrame([(v,) for v in (5, 5, 5, 6, 6, 7)], "value long")
    assert [(r["rank"], r["value"]) for r in workload.frequency_workload(base, values, 2, 2).collect()] == [(1, 5), (3, 7)]
    assert workload.frequency_workload(base, values.limit(0), 2, 2).count() == 0


def test_config(spark):
    c = Config.parse(SPEC)
    assert c.decays[1] == "rationalPower1,1,2,1" and c.operators[1].params == (5, 1000) and c.buffer == 62 and c.name() == Config.parse(SPEC).name()
    r = c.elements(spark).groupBy("stream_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.bool_and(F.col("is_landmark") == (F.col("value") >= 99)).alias("ok")).collect()
    assert len(r) == 2 and all(x.lo >= 100 and 4900 < x.hi <= 5000 and x.ok for x in r)
    assert c.queries(spark).filter("l < 100 or r > 5000").count() == 0
    with pytest.raises(ValueError):
        Config.parse(SPEC.replace("SimpleCount", "Nothing"))
    with pytest.raises(ValueError):
        Config.parse(SPEC.replace("Exponential", "Strange")).elements(spark)


def test_equal_times_are_elements_of_their_own(spark, monkeypatch, tmp_path):
    """Elements at one time all count, in every query; a landmark holds its own values, and operations tell them from normal ones at the same time."""
    from datetime import datetime, timedelta

    from tidemark import queries

    monkeypatch.setattr(build, "SLICE_ELEMENTS", 7)
    rng, t0, rows, t = random.Random(3), datetime(2024, 1, 1), [], 0
    for k in range(240):
        t += rng.choice([0, 0, 1, 40_000])
        rows.append((k, t0 + timedelta(seconds=t), k % 3, "view", rng.choice([12.0, 150.0, 250.0, 12.0])))
    path = str(tmp_path)
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    at = [int((r[1] - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for r in rows]
    v = [round(r[4] * 100) for r in rows]
    run = lambda name: sorted(tuple(r) for r in queries.QUERIES[name](spark, path).collect())
    days = {}
    for a, x in zip(at, v):
        days.setdefault(a // queries.DAY, []).append(x)
    assert run("exact_by_day") == sorted((d, len(x), sum(x), max(x)) for d, x in days.items())
    totals = [(d, sum(x)) for d, x in sorted(days.items())]
    assert run("outlier_days") == [(d, b, b - a) for (_, a), (d, b) in zip(totals, totals[1:]) if abs(b - a) > 100_000]
    assert run("observation_statistics")[0] == (240, round(statistics.mean(v), 4), round(statistics.stdev(v), 4), min(v), max(v))
    assert run("dyadic_range_count") == [(240,)] and run("range_frequency") == [(sum(x == 1200 for x in v), True)]
    assert run("landmark_operations") == [(h, sum((x >= queries.HOT) == h for x in v), sum(x for x in v if (x >= queries.HOT) == h)) for h in (False, True)]
    assert sum(r[1] for r in run("repeated_stream")) == 720 and sum(r[2] for r in run("repeated_stream")) == 3 * sum(v)
    marks = run("landmark_windows")
    assert sum(r[2] for r in marks) == sum(x >= queries.HOT for x in v)
    assert all(any(a <= x and (b is None or x <= b) for a, b, *_ in marks) for x, y in zip(at, v) if y >= queries.HOT)
    inside = [(a, x) for a, x in zip(at, v) if 3 * queries.HOUR <= a % (2 * queries.DAY) < 12 * queries.HOUR]
    stored = run("store_landmarks")
    assert sum(r[2] for r in stored) == len(inside) and sum(r[3] for r in stored) == sum(x for _, x in inside)


def test_layouts_without_a_step_for_each_element():
    """A long stream's windows are worked out at once, and are those of the merger."""
    import time

    from tidemark.plans import layout as L

    for spec in ("exponential2", "exponential1.5", "rationalPower1,1", "rationalPower1,1,8,1", "rationalPower2,3,3,2", "rationalPower1,0"):
        m, d = L.Merger(L.parse_decay(spec)), L.parse_decay(spec)
        for n in range(700):
            assert L.settled(d, n) == m.windows()
            m.append()
    assert L.settled(L.Decay(lambda: iter((5, 2, 9, 9, 9))), 8) is None
    began = time.time()
    w = L.settled(L.parse_decay("rationalPower1,1"), 36_000_000)
    assert time.time() - began < 5 and w[0][0] == 0 and w[-1][1] == 35_999_999 and all(b[0] == a[1] + 1 for a, b in zip(w, w[1:]))


def test_one_stream_is_many_tasks(spark, monkeypatch):
    """Elements meet the plan of slices without going to one task by their stream, and landmark totals are worked out in slices."""
    monkeypatch.setattr(build, "SLICE_ELEMENTS", 50)
    e = build.checked(spark.range(4000).selectExpr("0L as stream_id", "id * 3 as ts", "id % 7 as value"), "keep")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [len(p) for p in build.numbered(e).rdd.glom().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1500
        asks = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate([(0, -5), (0, 0), (0, 2), (0, 5999), (0, 11997), (0, 90_000), (1, 7)])], "qid long, stream_id long, t long")
        found = build.running(asks, {"x": F.col("t")}, e.select("stream_id", "ts", "value"), "value")
        got = {r.qid: (r.t, r.stream_id, r.x) for r in found.collect()}
        for t, s, x in got.values():
            assert (x.value if x else 0) == (sum(k % 7 for k in range(4000) if 3 * k <= t) if s == 0 else 0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_maximum_of_many_landmark_values(spark, monkeypatch):
    from tidemark.operators import estimator

    monkeypatch.setattr(build, "SLICE_ELEMENTS", 5)
    rng = random.Random(5)
    rows = [(s, 2 * k, rng.randint(0, 1000)) for s in (0, 1) for k in range(200)] + [(2, 4, 9)]
    asks = [(k, s, min(a, b), max(a, b)) for k, (s, a, b) in enumerate((rng.randint(0, 3), rng.randint(0, 420), rng.randint(0, 420)) for _ in range(60))]
    q = spark.createDataFrame(asks, "qid long, stream_id long, t0 long, t1 long")
    parts = estimator.exact_merged(q, spark.createDataFrame(rows, ROWS), {"max": F.max("value")}, {"max": F.max})
    got = {r.qid: r.v for r in parts.groupBy("qid").agg(F.max("max").alias("v")).collect()}
    for qid, s, a, b in asks:
        assert got.get(qid) == max((v for x, t, v in rows if x == s and a <= t <= b), default=None)


def test_sketches_of_long_streams(spark):
    """Among fewer neighbouring integers than a row has columns, frequencies are exact; bits are sorted once each."""
    from tidemark.operators import estimator

    e = build.checked(spark.range(60_000).selectExpr("0L as stream_id", "id as ts", "cast(floor(600 * pow((id * 7919 % 60000) / 60000.0, 3)) as bigint) as value"), "keep")
    m = build.assigned(e, "exponential2").cache()
    truth = m.groupBy("value").agg(F.count("*").alias("truth"))
    q = truth.selectExpr("value as qid", "0L as stream_id", "0L as l", "59999L as r", "value")
    a = estimator.frequency(q, build.summarise(m), build.cms_cells(m), build.stream_stats(e), *build.CMS)
    assert a.join(truth.withColumnRenamed("value", "qid"), "qid").filter("abs(result - truth) > 1e-6").count() == 0
    bits = build.bloom_bits(m)
    assert "HashAggregate" in bits._jdf.queryExecution().executedPlan().toString()
