import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions.scalars import config_hash, normal_quantile
from tidemark.operators import build, estimator, evaluate, workload
from tidemark.operators.specs import parse_operator
from tidemark.plans import layout as L
from tidemark.sources import streams
from tidemark.sources.store import Store, StreamError
from tidemark.streaming.ingest import ingest

TS = [0, 496, 744, 868, 930, 961, 977, 992, 1000, 1008, 1012, 1016, 1018, 1020, 1021]
COUNTS = [491, 243, 124, 62, 31, 16, 15, 8, 8, 4, 4, 2, 2, 1, 1]
MAXES = [9, 9, 9, 9, 9, 9, 9, 9, 7, 9, 5, 7, 9, 0, 1]


def test_layout_evolution():
    want = [[1], [1, 1], [2, 1], [2, 1, 1], [2, 2, 1], [2, 2, 1, 1], [4, 2, 1], [4, 2, 1, 1], [4, 2, 2, 1], [4, 2, 2, 1, 1], [4, 4, 2, 1], [4, 4, 2, 1, 1], [4, 4, 2, 2, 1], [4, 4, 2, 2, 1, 1], [8, 4, 2, 1]]
    m = L.Merger(L.exponential(2))
    for sizes in want:
        m.append()
        assert [b - a + 1 for a, b in m.windows()] == sizes


def test_decay_arithmetic():
    d = L.exponential(2)
    assert [d.first_containing(x, 99, 100) for x in (98, 96, 92, 84)] == [101, 103, 107, 115]
    assert d.covering(62) == [1, 2, 4, 8, 16] and d.covering(63) == [1, 2, 4, 8, 16, 32] and d.first_window() == 1
    assert L.Decay(lambda: (i * 2492 for i in range(1, 99))).first_window() == 2492
    assert L.rational_power(1, 0, 1, 3).first_containing(0, 5, 6) == -1
    assert len(L.layout("rationalPower1,1", 100_000)) == 645 and len(L.layout("rationalPower1,1,2,1", 100_000)) == 894
    assert [a for a, _ in L.layout("exponential2", 1022, 31)] == TS and len(L.layout("exponential2", 1022)) == 18
    assert L.buffer_size(d, 62) == 31
    with pytest.raises(ValueError):
        L.parse_decay("linear3")


def golden(spark):
    return spark.range(1022).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("ts"), (F.col("id") % 10).alias("value"), F.col("id").between(491, 500).alias("is_landmark"))


def test_golden_stream(spark):
    e = golden(spark)
    m = build.assigned(e, "exponential2", 31).cache()
    w = build.summarise(m).cache()
    rows = w.orderBy("ts").collect()
    assert [r.ts for r in rows] == TS == [r.cs for r in rows] and [r["count"] for r in rows] == COUNTS and [r.max for r in rows] == MAXES
    assert [r.te for r in rows] == [*(t - 1 for t in TS[1:]), 1021]
    stats, marks, values = build.stream_stats(e), spark.createDataFrame([(0, 491, 500)], "stream_id long, ts long, te long"), e.filter("is_landmark")
    ask = spark.createDataFrame([(1, 0, 1, 511), (2, 0, 0, 1021), (3, 0, 5000, 6000), (4, 7, 0, 5)], "qid long, stream_id long, l long, r long")
    ones = values.select("stream_id", "ts", F.lit(1).alias("s"))
    got = {r.qid: (r.result, r.ci_low, r.ci_high) for r in estimator.estimate(ask, w, stats, "count", estimator.count_multiplier(), 0.95, marks, ones).collect()}
    assert got == {1: (511, 511, 511), 2: (1022, 1022, 1022), 3: (0, 0, 0), 4: (0, 0, 0)}
    eight = ask.filter("qid = 1").withColumn("value", F.lit(8).cast("long"))
    f = estimator.frequency(eight, w, build.cms_cells(m, 5, 100), stats, 5, 100, 1.0, marks, values).first()
    assert abs(f.result - 50.9866234190742) < 1e-9 and (f.ci_low, f.ci_high) == (1, 74)
    top = {r.qid: (r.result, r.certain) for r in estimator.interval_max(ask, w, stats, values).collect()}
    assert top[1] == (9, False) and top[3] == (None, True)
    assert estimator.membership(eight, w, build.bloom_bits(m), stats, *build.BLOOM).first().found
    assert not estimator.membership(eight.withColumn("value", F.lit(77).cast("long")), w, build.bloom_bits(m), stats, *build.BLOOM).first().found
    with pytest.raises(Exception, match="0 <= l <= r"):
        estimator.clamped(spark.createDataFrame([(1, 0, 9, 3)], "qid long, stream_id long, l long, r long"), stats).collect()


def test_numbering_of_many_streams(spark):
    e = build.checked(streams.events(spark, "/root/testdata/sf0.01", "user_id"))
    rows = build.numbered(e).select("stream_id", "ts", "c", "n").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r.stream_id, r.ts)):
        assert r.c == seen.get(r.stream_id, 0)
        seen[r.stream_id] = r.c + 1
    assert all(seen[r.stream_id] == r.n for r in rows)
    w = build.build_windows(e, "exponential2")
    for r in w.groupBy("stream_id").agg(F.collect_list(F.struct("cs", "ce")).alias("w")).collect():
        assert sorted(map(tuple, r.w)) == list(L.layout("exponential2", seen[r.stream_id]))


def ask(spark, *rows):
    return spark.createDataFrame([(k, 0, l, r) for k, (l, r) in enumerate(rows)], "qid long, stream_id long, l long, r long")


def test_store_golden_stream(spark, tmp_path):
    """The golden stream through the store alone, in batches, with a landmark that is open between two of them."""
    e = golden(spark).select("stream_id", F.lit("APPEND").alias("op"), "ts", "value")
    edge = spark.createDataFrame([(0, "LANDMARK_START", 491, None), (0, "LANDMARK_END", 500, None)], "stream_id long, op string, ts long, value long")
    every = e.unionByName(edge)
    s = Store(spark, str(tmp_path / "s"))
    assert s.register(0, "exponential2", ["SimpleCountOperator", "CMSOperator5,100", "MaxOperator", "BloomFilterOperator5,32768", "HyperLogLogOperator", "TDigestOperator"], 62) and not s.register(0, "exponential2", [])
    s.append_operations(every)
    w = s.windows().orderBy("ts").collect()
    assert [r.ts for r in w] == TS and [r["count"] for r in w] == COUNTS and [r.max for r in w] == MAXES and [(m.ts, m.te, m.n_values) for m in s.landmarks().collect()] == [(491, 500, 10)]
    q = ask(spark, (1, 511), (0, 1021))
    assert [tuple(r) for r in s.query(q, "COUNT").orderBy("qid").collect()] == [(0, 511, 511, 511), (1, 1022, 1022, 1022)]
    f = s.query(q.filter("qid = 0").withColumn("value", F.lit(8).cast("long")), "CMS", 1.0).first()
    assert abs(f.result - 50.9866234190742) < 1e-9 and (f.ci_low, f.ci_high) == (1, 74)
    assert [tuple(r) for r in s.query(q, "MAX").orderBy("qid").collect()] == [(0, 9, False), (1, 9, False)]
    v = q.filter("qid = 1").withColumn("value", F.explode(F.array(*(F.lit(x).cast("long") for x in (3, 77))))).withColumn("qid", F.col("value"))
    assert [(r.qid, r.found) for r in s.query(v, "BLOOM").orderBy("qid").collect()] == [(3, True), (77, False)]
    assert s.query(q, "DISTINCT").filter("abs(result - 10) > 0.1").count() == 0 and s.query(q, "QUANTILE", q=0.5).filter("result not in (4, 5)").count() == 0
    assert s.query(q.filter("qid = 1"), "RANGE", low=2, high=4).filter("abs(result - 306) > 15").count() == 0 and s.query(q, "THRESHOLD", threshold=8).filter("above").count() == 2
    m = s.query(q.filter("qid = 1"), "MEAN").first()
    assert abs(m.result - sum(t % 10 for t in range(1022)) / 1022) < 1e-9
    assert s.operator_index(0, "MAX") == 2 and tuple(s.window_counts().first()) == (0, 15, 1) and s.describe().count() == 16
    again = Store(spark, s.path, readonly=True, cache=True)
    again.unload(0)
    for bad in (lambda: s.append(golden(spark).filter("ts = 5")), lambda: again.append(golden(spark)), lambda: s.operator_index(0, "QUANTUM"), lambda: s.append(golden(spark).withColumn("stream_id", F.lit(9))), lambda: again.query(q, "COUNT"), lambda: s.query(q.withColumn("stream_id", F.lit(5)), "SUM"), lambda: Store(spark, str(tmp_path / "none"), readonly=True)):
        with pytest.raises(StreamError):
            bad()
    again.load(0)
    assert again.query(q, "COUNT").count() == 2 and s.vacuum(1) >= 0 and s.query(q, "COUNT").count() == 2
    again.close()
    one = s.window(0, 1021)
    assert [tuple(r) for r in one.select("ts", "count").collect()] == [(1021, 1)]
    s.put_window(one.withColumn("max", F.lit(7).cast("long")))
    assert s.window(0, 1021).first().max == 7
    s.delete_window(0, 1021)
    assert s.window(0, 1021).count() == 0 and s.windows().count() == 14
    s.append_now(spark.createDataFrame([(0, 5), (0, 6)], "stream_id long, value long"))
    assert s.stats().first().n == 1024


def test_store_appends_in_any_batches(spark, tmp_path):
    e, stores = golden(spark), []
    every = e.select("stream_id", F.lit("APPEND").alias("op"), "ts", "value").unionByName(spark.createDataFrame([(0, "LANDMARK_START", 491, None), (0, "LANDMARK_END", 500, None)], "stream_id long, op string, ts long, value long"))
    for k, cuts in enumerate(([0, 1022], [0, 400, 495, 1022])):
        s = Store(spark, str(tmp_path / f"s{k}"))
        s.register(0, "exponential2", ["SumOperator", "CMSOperator2,50"])
        s.register(7, "rationalPower1,1", ["BloomFilterOperator"])
        for a, b in zip(cuts, cuts[1:]):
            s.append_operations(every.filter(F.col("ts").between(a, b - 1)))
        stores.append(s)
    one, two = (sorted((r.cs, r.ce, r["count"], r["sum"], r.max) for r in s.windows().collect()) for s in stores)
    assert one == two and [(a, b) for a, b, *_ in one] == list(L.layout("exponential2", 1022))
    assert [tuple(r) for r in stores[1].table("marks").collect()] == [(0, 491, 500)]
    assert sorted(map(tuple, stores[0].table("cells").collect())) == sorted(map(tuple, stores[1].table("cells").collect()))
    a, b = (s.stats().first().asDict() for s in stores)
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_a_failed_append_changes_nothing(spark, tmp_path, monkeypatch):
    e = golden(spark)
    s = Store(spark, str(tmp_path / "s"))
    s.register(0, "exponential2", ["SumOperator", "CMSOperator2,50", "BloomFilterOperator"])
    s.append(e.filter("ts < 20"), batch=0)
    before = sorted(map(tuple, s.windows().select("cs", "ce", "sum").collect()))
    for name, at in (("_write", 1), ("_write", 2), ("_write", 4), ("_put", 1)):
        calls = []

        def fail(self, *args, real=getattr(Store, name), at=at, calls=calls):
            calls.append(1)
            if len(calls) == at:
                raise OSError("lost")
            return real(self, *args)

        with monkeypatch.context() as m:
            m.setattr(Store, name, fail)
            with pytest.raises(OSError):
                s.append(e.filter("ts between 20 and 99"), batch=1)
        again = Store(spark, s.path)
        assert sorted(map(tuple, again.windows().select("cs", "ce", "sum").collect())) == before and again.batch() == 0
    again.append(e.filter("ts between 20 and 99"), batch=1)
    assert sorted((r.cs, r.ce) for r in again.windows().collect()) == list(L.layout("exponential2", 100)) and again.batch() == 1


def test_two_writers(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    state = s._state()
    s.register(0, "exponential2", ["SumOperator"])
    with pytest.raises(StreamError):
        s._commit(state)
    assert 0 in s.registry()


def test_streaming_ingest(spark, tmp_path):
    e = golden(spark).drop("is_landmark")
    for a, b in ((0, 499), (500, 1021)):
        e.filter(F.col("ts").between(a, b)).unionByName(e.filter(F.col("ts") == 7)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = Store(spark, str(tmp_path / "store"))
        s.register(0, "exponential2", ["SumOperator"])
        q = ingest(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), s, str(tmp_path / "check"), aside=str(tmp_path / "late"))
        q.awaitTermination(120)
    assert sorted((r.cs, r.ce) for r in s.windows().collect()) == list(L.layout("exponential2", 1022))
    assert s.late() == 1 and s.batch() == 1 and spark.read.parquet(str(tmp_path / "late")).count() == 1
    ops = e.select("stream_id", F.lit("APPEND").alias("op"), "ts", "value").unionByName(spark.createDataFrame([(0, "LANDMARK_START", 491, None), (0, "LANDMARK_END", 500, None)], "stream_id long, op string, ts long, value long"))
    for a, b in ((0, 494), (495, 1021)):
        ops.filter(F.col("ts").between(a, b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    t = Store(spark, str(tmp_path / "store2"))
    t.register(0, "exponential2", ["SumOperator"])
    ingest(spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops")), t, str(tmp_path / "check2")).awaitTermination(120)
    assert t.batch() == 1 and [tuple(r) for r in t.table("marks").collect()] == [(0, 491, 500)] and t.table("values").count() == 10


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,5\n\n# no\n1,6\n2,7\n900,1\n")
    assert [tuple(r) for r in streams.csv(spark, str(tmp_path / "x.csv"), 3, 0, 100).orderBy("ts").collect()] == [(3, 1, 5), (3, 2, 7)]
    s = streams.synthetic(spark, 5000, ("exponential", 0.1), ("uniform", 1, 100), seed=4, streams=2)
    r = s.groupBy("stream_id").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("d"), F.avg("value").alias("v"), F.max("ts").alias("t")).collect()
    assert [(x.n, x.d) for x in r] == [(5000, 5000)] * 2 and all(48 < x.v < 53 and 48_000 < x.t < 58_000 for x in r)
    z = streams.synthetic(spark, 4000, ("pareto", 2.0, 2.01), ("zipf", 10, 1.0)).groupBy("value").count().orderBy("value").collect()
    assert [x.value for x in z] == list(range(1, 11)) and z[0]["count"] > 2.5 * z[3]["count"]


def test_landmark_runs(spark):
    e = spark.createDataFrame([(0, t, v) for t, v in zip((0, 2, 4, 6, 8), (1, 1, 9, 9, 1))], "stream_id long, ts long, value long")
    assert [tuple(r) for r in build.landmark_windows(e, 9).collect()] == [(0, 3, 7, 2, 18)]
    assert build.landmark_windows(e, 1).first().te is None


def test_unit_rate_counts_and_small_functions(spark):
    e = spark.range(2001).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("ts"), F.lit(1).cast("long").alias("value"))
    q = spark.range(200).select(F.col("id").alias("qid"), F.lit(0).cast("long").alias("stream_id"), (F.col("id") * 7 % 900).alias("l"), (1000 + F.col("id") * 5).alias("r"))
    assert workload.true_answers(q, e, 37).filter("true_count != r - l + 1 or true_sum != true_count").count() == 0
    assert abs(normal_quantile(0.95) - 1.959964) < 1e-5 and normal_quantile(1) is None
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1})
    assert parse_operator("CMSOperator5,1000").params == (5, 1000) and build.dyadic_nodes(1, 6) == [(0, 1), (1, 1), (1, 2), (0, 6)]
    with pytest.raises(ValueError):
        parse_operator("Nothing")


def test_optimal_layout():
    n, measure = 8, evaluate.zipf_measure(8, 1.0, 1.0)
    lengths, cost = evaluate.optimal_layout(n, 8, measure)
    assert lengths == [1] * 8 and abs(cost) < 1e-12
    assert evaluate.optimal_layout(n, 3, measure)[1] <= evaluate.optimal_layout(n, 2, measure)[1]
    assert evaluate.value_aware_layout(np.array([5, 5, 5, 5, 0, 0, 9, 9]), 3, measure)[1] < 1e-9


def test_queries_have_sql():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"comparison_profile"} and set(queries.ORACLES) <= set(queries.QUERIES)


def test_estimates_like_ticks(spark):
    """Random windows, gaps, landmarks and queries against sets of ticks; sums of either sign."""
    rng = np.random.default_rng(11)
    windows, marks, values, asks, want = [], [], [], [], {}
    for stream in range(12):
        at, mine = int(rng.integers(0, 5)), []
        for _ in range(int(rng.integers(1, 7))):
            end = at + int(rng.integers(0, 30))
            mine.append((at, end, int(rng.integers(-50, 90))))
            at = end + 1 + int(rng.integers(0, 6))
        last = mine[-1][1]
        lands = [(a, None if rng.random() < 0.1 else a + int(rng.integers(0, 25))) for a in rng.integers(0, last + 1, int(rng.integers(0, 4))).tolist()]
        taken = {t for a, b in lands for t in range(a, (last if b is None else b) + 1)}
        exact = [(int(t), int(rng.integers(1, 9))) for t in sorted(taken) if rng.random() < 0.3 and t <= last]
        windows += [(stream, *w) for w in mine]
        marks += [(stream, *x) for x in lands]
        values += [(stream, *x) for x in exact]
        for _ in range(25):
            l = int(rng.integers(mine[0][0], last + 1))
            r = int(rng.integers(l, last + 20))
            qid = len(asks)
            asks.append((qid, stream, l, r))
            r = min(r, last)
            hit = [w for w in mine if w[0] <= r and w[1] >= l]
            total = float(sum(v for t, v in exact if l <= t <= r)) + sum(w[2] for w in hit[1:-1])
            low = high = total
            for k, w in enumerate([hit[0], hit[-1]] if len(hit) > 1 else hit):
                end = w[1] if k or len(hit) == 1 else hit[1][0] - 1  # a window reaches to the next one's start
                span = set(range(w[0], end + 1)) - taken
                part = {t for t in span if l <= t <= r}
                total += w[2] * len(part) / len(span) if span else 0
                whole = w[2] if len(part) == len(span) else 0
                low, high = low + min(w[2], whole), high + max(w[2], whole)
            want[qid] = total, min(low, total), max(high, total)
    w = spark.createDataFrame(windows, "stream_id long, ts long, te long, s long")
    stats = w.groupBy("stream_id").agg(F.min("ts").alias("first_ts"), F.max("te").alias("last_ts"))
    m, v = spark.createDataFrame(marks, "stream_id long, ts long, te long"), spark.createDataFrame(values, "stream_id long, ts long, s long")
    q = spark.createDataFrame(asks, "qid long, stream_id long, l long, r long")
    for confidence in (1.0, 0.9):
        got = estimator.estimate(q, w, stats, "s", F.lit(0.7), confidence, m, v).collect()
        assert len(got) == len(want)
        for r in got:
            total, low, high = want[r.qid]
            assert abs(r.result - total) < 1e-6 and r.ci_low <= r.result + 1e-9 and r.result <= r.ci_high + 1e-9, (r, want[r.qid])
            if confidence == 1:
                assert abs(r.ci_low - low) < 1e-6 and abs(r.ci_high - high) < 1e-6, (r, want[r.qid])
            else:
                assert r.ci_low >= low - 1e-6 and r.ci_high <= high + 1e-6
    one = spark.createDataFrame([(0, 0, 100, 90)], "stream_id long, ts long, te long, s long")
    got = estimator.estimate(spark.createDataFrame([(0, 0, 0, 10)], "qid long, stream_id long, l long, r long"), one, one.selectExpr("stream_id", "0L as first_ts", "100L as last_ts"), "s", F.lit(0.0), 1.0, spark.createDataFrame([(0, 5, 60)], "stream_id long, ts long, te long")).first()
    assert abs(got.result - 90 * 5 / 45) < 1e-9 and got.ci_low == 0 and got.ci_high == 90


def test_landmarks_in_other_answers(spark):
    e = spark.createDataFrame([(0, t, v, t in (30, 31)) for t, v in enumerate([*range(30), 500, 501, *range(8)])], "stream_id long, ts long, value long, is_landmark boolean")
    m = build.assigned(e, "exponential2")
    w, stats, marks = build.summarise(m), build.stream_stats(e), e.filter("is_landmark")
    q = spark.createDataFrame([(k, 0, l, r, v) for k, (l, r, v) in enumerate([(0, 39, 500), (0, 29, 500), (0, 39, 77), (0, 39, 3), (31, 31, 501)])], "qid long, stream_id long, l long, r long, value long")
    got = {r.qid: (r.found, r.error) for r in estimator.membership(q, w, build.bloom_bits(m), stats, *build.BLOOM, marks).collect()}
    assert [got[k][0] for k in range(5)] == [True, False, False, True, True] and got[0][1] == got[1][1] == got[4][1] == 0 and 0 < got[3][1] < 1
    top = {r.qid: r.result for r in estimator.quantile(q, w, stats, 1.0, marks).collect()}
    assert top[0] == 501
    n = {r.qid: r.result for r in estimator.distinct_count(q, w, stats, marks).collect()}
    assert n[0] == 32 and n[1] == 30
    assert {r.qid: r.result for r in estimator.range_frequency(q, w, stats, 400, 501, landmarks=None, landmark_values=marks).collect()}[0] == 2


def test_user_aggregates(spark):
    e = spark.range(300).selectExpr("0L as stream_id", "id as ts", "id % 7 as value")
    own = {"low": F.min, "squares": lambda v: F.sum(v * v)}
    w = build.build_windows(build.checked(e), "exponential2", **own)
    coarse = build.merge_windows(w.withColumn("cs", F.lit(0).cast("long")).withColumn("ce", F.lit(299).cast("long")), low=F.min, squares=F.sum).first()
    assert (coarse.low, coarse.squares, coarse["count"]) == (0, sum((i % 7) ** 2 for i in range(300)), 300)


def test_units_of_windows(spark, monkeypatch):
    """Merged units give what all touched windows give."""
    monkeypatch.setattr(estimator, "UNIT", 4)
    w = spark.range(40).selectExpr("0L as stream_id", "id * 10 as ts", "id * 10 + 7 as te", "(id * 37) % 101 as max")
    stats = spark.createDataFrame([(0, 0, 397)], "stream_id long, first_ts long, last_ts long")
    q = spark.range(400).selectExpr("id as qid", "0L as stream_id", "(id * 17) % 390 as l", "(id * 17) % 390 + (id * 31) % 97 as r")
    rows = [(r.ts, r.te, r.max) for r in w.collect()]
    for r in estimator.interval_max(q, w, stats).join(q, "qid").collect():
        assert r.result == max((m for a, b, m in rows if a <= min(r.r, 397) and b >= r.l), default=None), r
