"""Operator 6: nearest neighbours by vantage-point trees, one for each shard of the rows.

The measure is the inner product.  A shard has a tree for each band of norms, a
power of two wide.  With every vector x of a band divided by M, the band's greatest
norm, and extended by sqrt(1 - |x / M|^2), and a query q divided by its norm and
extended by 0, the squared distance of the two is 2 - 2 q.x / (|q| M), so the nearest
vectors are those with the largest product, and the triangle inequality holds.  A
node splits its vectors at the median distance to a vantage point; a child is skipped
when the least distance that the inequality allows, times ``factor``, is beyond the
current k-th best product of all bands.  factor 1 is exact; larger ones skip more, by
the same measure in every band and for every query, whatever the norms of the rest.
Equal vectors of a shard are one point of its tree with its smallest ids.  Products
of a leaf are found at once and those within rounding of the k-th best are found
again, each by itself and always in the same order of summation, so that ties are
seen as ties; points are numbered by their smallest ids, to which ties go.

A shard's rows come to one task, which builds its trees once; the queries then
stream past, a batch at a time, and each sends its k best on.  Every query meets
every shard: the copies of queries grow with queries times shards, which is why a
shard has as many rows as a task can hold; rows are never copied.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part; vectors of different lengths never meet; rows with a null vec_id are
left out; rows that share a vec_id are one, the smallest of their vectors; a query
with no candidate has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import shuffle_partitions

K, EVERY, FACTOR = 20, 20, 1.1
#: Rows of a shard; smaller tables have more shards, of LEAST_ROWS, to have work for all tasks.
SHARD_ROWS, LEAST_ROWS, LEAF, FEW_LENGTHS = 32_768, 2048, 96, 10_000
#: Queries searched at once.
QUERY_ROWS = 2048


def lengths(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


class VPTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, seed: int = 5):
        """points: distinct vectors of one band, not zero; ids: their rows."""
        self.points, self.ids = points, ids
        self.top = lengths(points).max() * (1 + 1e-12)
        self.unit = points / self.top
        self.rest = np.sqrt(np.maximum(1 - (self.unit * self.unit).sum(1), 0))
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(rows) > LEAF:
            trial = rows[self.rng.integers(0, len(rows), 5)]
            far = np.sqrt(np.maximum(((self.unit[trial, None] - self.unit[None, rows[:: max(1, len(rows) // 100)]]) ** 2).sum(2), 0))
            vantage = trial[int(far.std(1).argmax())]
            d = np.sqrt(((self.unit[rows] - self.unit[vantage]) ** 2).sum(1) + (self.rest[rows] - self.rest[vantage]) ** 2)
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            inner, outer = order[:half], order[half:]
            spans = d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max()
            self.nodes[me] = vantage, spans, self._build(rows[inner]), self._build(rows[outer])
        else:
            self.nodes[me] = (rows,)
        return me

    def search(self, queries: np.ndarray, best: np.ndarray, rows: np.ndarray, factor: float) -> None:
        """Puts what this tree has into the largest products found so far and the rows of their points (-1: none)."""
        k, self.looked = best.shape[1], 0
        norms = lengths(queries)
        units = queries / norms[:, None]

        def room(who: np.ndarray) -> np.ndarray:
            """Square of the distance of the k-th best; infinite until k are known, below 0 if no point of the band can reach it."""
            return 2 - 2 * (best[who].min(1) / norms[who] / self.top)

        def leaf(node: int, who: np.ndarray) -> None:
            mine = self.nodes[node][0]
            self.looked += len(who) * len(mine)
            near = queries[who] @ self.points[mine].T >= (best[who].min(1) - 1e-11 * norms[who] * self.top)[:, None]
            some = near.any(1)
            who, near = who[some], near[some]
            if len(who) == 0:
                return
            i, j = np.nonzero(near)
            found, ids = np.full(near.shape, -np.inf), np.where(near, self.ids[mine][None, :], np.iinfo(np.int64).max)
            found[i, j] = products(queries[who[i]], self.points[mine[j]])
            found, ids = np.concatenate([best[who], found], 1), np.concatenate([rows[who], ids], 1)
            keep = np.lexsort((ids, -found), axis=1)[:, :k]
            best[who], rows[who] = np.take_along_axis(found, keep, 1), np.take_along_axis(ids, keep, 1)

        def distance(node: int, who: np.ndarray) -> np.ndarray:
            v = self.nodes[node][0]
            return np.sqrt(np.maximum(((units[who] - self.unit[v]) ** 2).sum(1) + self.rest[v] ** 2, 0))

        seen: dict[int, np.ndarray] = {}

        def descend(node: int, who: np.ndarray) -> None:  # first each query's own leaf
            if len(who) == 0:
                return
            if len(self.nodes[node]) == 1:
                leaf(node, who)
                seen[node] = who
                return
            _, (_, a, b, _), inner, outer = self.nodes[node]
            d = distance(node, who)
            near = d <= (a + b) / 2
            descend(inner, who[near])
            descend(outer, who[~near])

        def visit(node: int, who: np.ndarray) -> None:
            if len(who) == 0:
                return
            if len(self.nodes[node]) == 1:
                who = np.setdiff1d(who, seen.get(node, who[:0]), assume_unique=True)
                if len(who):
                    leaf(node, who)
                return
            _, (a, b, c, e), inner, outer = self.nodes[node]
            d = distance(node, who)
            for child, lo, hi in ((inner, a, b), (outer, c, e)):
                least = np.maximum(np.maximum(lo - d, d - hi), 0)
                reach = np.sqrt(np.maximum(room(who), 0) + 1e-13)
                visit(child, who[~(least * factor > reach * (1 + 1e-9))])

        some = np.flatnonzero(room(np.arange(len(queries))) >= -1e-9)
        descend(self.root, some)
        visit(self.root, some)


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Row by row, always in the same order of summation, so equal vectors give equal values."""
    return np.einsum("ij,ij->i", queries, points)


class Shard:
    """The trees of one shard's rows, one for each band of norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        _, head, which = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        place = np.argsort(np.argsort(head))  # points by their smallest ids
        which = place[which.ravel()]
        self.points = vectors[np.sort(head)]
        self.members = np.argsort(which, kind="stable")  # ids of a point in ascending order
        self.first = np.searchsorted(which[self.members], np.arange(len(self.points) + 1))
        band = np.frexp(lengths(self.points))[1]
        self.trees = [VPTree(self.points[mine], mine) for mine in (np.flatnonzero(band == b) for b in np.unique(band)[::-1])]  # the longest first

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the k best for each query, its own row left out."""
        most = min(k + 1, len(self.points))
        best, rows = np.full((len(queries), most), -np.inf), np.full((len(queries), most), -1)
        for tree in self.trees:
            tree.search(queries, best, rows, factor)
        at, slot = np.nonzero(rows >= 0)
        point, score = rows[at, slot], best[at, slot]
        count = np.minimum(self.first[point + 1] - self.first[point], k + 1)
        who = np.repeat(np.arange(len(at)), count)
        step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        vec, q, s = self.ids[self.members[self.first[point[who]] + step]], at[who], score[who]
        other = vec != query_ids[q]
        vec, q, s = vec[other], q[other], s[other]
        order = np.lexsort((vec, -s, q))
        vec, q, s = vec[order], q[order], s[order]
        out = np.arange(len(q)) - np.searchsorted(q, q) < k
        return query_ids[q[out]], vec[out], s[out]


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return Shard(ids, vectors).search(query_ids, queries, k, factor)


def _searched(k: int, factor: float):
    """Rows (dim, shard, asks, id, v) in order: of each shard its vectors, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            dim, place, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            vectors, at = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dim)])
            edges = np.flatnonzero((dim[1:] != dim[:-1]) | (place[1:] != place[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
                if (dim[lo], place[lo]) != key:
                    key, held, shard = (dim[lo], place[lo]), [], None
                part = vectors[at[lo] : at[hi]].reshape(hi - lo, -1)
                if not asks[lo]:
                    held.append((ids[lo:hi], part.copy()))
                    continue
                if not held and shard is None:
                    continue  # no row lies in this shard
                if shard is None:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held))), []
                for i in range(lo, hi, QUERY_ROWS):
                    j = min(hi, i + QUERY_ROWS)
                    found = shard.search(ids[i:j], part[i - lo : j - lo], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    v = F.col("v")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    base = base.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    if base.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        base = base.groupBy("vec_id").agg(F.min("v").alias("v"))
    base = base.withColumn("dim", F.size("v"))
    facts = base.groupBy("dim").agg(F.count("*").alias("n"))
    parts = shuffle_partitions(vectors.sparkSession)
    shards = F.ceil(F.greatest(F.col("n") / shard_rows, F.least(F.col("n") / LEAST_ROWS, F.lit(parts)))).cast("int")
    few = facts.count() <= FEW_LENGTHS  # a row of 16 bytes for each length of vectors
    told = base.join(F.broadcast(facts) if few else facts, "dim").withColumn("shards", shards)
    rows = told.select("dim", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = told.filter(F.pmod("vec_id", F.lit(every)) == 0).select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = rows.unionByName(asked).repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    best = dealt.mapInArrow(_searched(k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
