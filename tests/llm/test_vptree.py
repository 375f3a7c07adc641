import math

import numpy as np

from tidemark.llm import vptree


def brute(rows, k, every):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in ok.items():
        if q % every == 0:
            near = sorted((-float(np.einsum("i,i->", a, b)), i) for i, b in ok.items() if i != q and len(a) == len(b))[:k]
            out[q] = [i for _, i in near]
    return out


def run(spark, rows, **more):
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for r in vptree.nearest(df, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    return got


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(0, 1, 8) * rng.choice([0.5, 1, 3]), 2).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(3000, None), (3020, [0.0] * 8), (3040, [float("nan")] * 8), (3060, [None] + [1.0] * 7), (3080, [1.0, 2.0]), (3081, [2.0, 2.0]), (None, [1.0] * 8), (3100, [])]
    assert run(spark, rows, factor=1.0, shard_rows=400) == {q: v for q, v in brute(rows, 20, 20).items() if v}


def test_ties_of_different_vectors(spark):
    """400 different vectors with the same product: the smallest ids, also where others are nearer and where ids cross shards."""
    rng = np.random.default_rng(6)
    tied = [[1.0, *rng.integers(-9, 9, 5).astype(float).tolist()] for _ in range(400)]
    rows = [(0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])] + [(int(i), v) for i, v in zip(rng.permutation(np.arange(1, 401)), tied)] + [(901 + i, [2.0 + i, 1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(3)]
    rows = [r for r in rows if r[0] % 20 or r[0] == 0]
    assert run(spark, rows, factor=1.0, shard_rows=150) == brute(rows, 20, 20)
    assert run(spark, rows, factor=1.0)[0] == [903, 902, 901, *range(1, 18)]
    grid = [(i, [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(rng.integers(-3, 4, (1500, 3)).tolist())]
    assert run(spark, grid, factor=1.0, shard_rows=300) == {q: v for q, v in brute(grid, 20, 20).items() if v}


def test_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i, "s", 0.5) for i in range(1, 41)], "vec_id long, embedding array<float>, rank int, shard string, score double")
    got = vptree.nearest(df, k=2)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == [(20, 1, 40), (20, 2, 39), (40, 1, 39), (40, 2, 38)]


def test_recall_of_the_default_factor(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, true = run(spark, rows), brute(rows, 20, 20)
    assert sum(len(set(got[q]) & set(v)) for q, v in true.items()) >= 0.95 * sum(map(len, true.values()))


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}
    assert run(spark, [(0, [1.0]), (7, [2.0]), (7, [2.0])]) == {0: [7]}


def test_recall_among_outlier_norms():
    """A few long vectors, or norms of every size, do not spoil the search of the others."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 32))
    base = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.4, (4000, 32))
    base /= np.sqrt((base * base).sum(1))[:, None]
    ids = np.arange(len(base))
    spread = 10.0 ** rng.uniform(-4, 4, len(base))
    for scale in (np.where(ids == 7, 30.0, 1.0), np.where(ids % 1000 == 7, 1000.0, 1.0), np.where(ids % 40 == 0, 300.0, 1.0), spread):
        vectors = base * scale[:, None]
        asked = ids[ids % 20 == 0]
        for factor, least in ((vptree.FACTOR, 0.95), (1.0, 1.0)):
            q, v, _ = vptree.search_shard(ids, vectors, asked, vectors[asked], 20, factor)
            got = set(zip(q.tolist(), v.tolist()))
            near = np.where(asked[:, None] == ids, -np.inf, vectors[asked] @ vectors.T).argsort(1)[:, -20:]
            true = {(int(a), int(b)) for a, row in zip(asked, near) for b in row}
            assert len(true & got) >= least * len(true), (factor, len(true & got) / len(true))
