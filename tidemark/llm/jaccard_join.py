"""Operator 4: exact n-gram Jaccard join with signature trees.

A document's set holds its distinct ``n``-word shingles (one shingle of all words
when it has fewer; nothing when it has none).  Documents link when
100 * |x & y| >= percent * |x | y|; the result is each document's component.

1. Documents with the same words in the same order are one class, found by a
   128-bit BLAKE2 digest of the words; its smallest id stands for it.
2. Every linked pair shares one of the first |x| - ceil(t |x|) + 1 shingles of
   each set in any fixed order, so those prefixes find all candidates.  Shingles
   that a bounded sample of documents shows to be widespread come last in that
   order; the order changes the work and not the result.
3. Within blocks of documents that share one of their first three shingles,
   links are found at once and joined to components.  This settles nearly all
   documents of a large group of copies without a look at all of its pairs.
4. Shingle groups of the prefixes that still span several components are taken
   together by their smallest document to families, so that a document comes once
   where it shares many shingles.  Families are searched with signature trees:
   nodes hold the OR of their members' token bitmaps and their size range, and a
   dual traversal drops pairs of nodes whose greatest possible overlap is too
   small, or that lie in one component.  A family beyond GROUP_ROWS is dealt into
   blocks, and pairs of blocks are searched.
5. Documents with a pair left are searched once more with their texts, by wider
   bitmaps and then shingle by shingle, and the links join components.

Trees and prefixes work on 64-bit fingerprints of shingles.  A link only counts
once the two documents' words have been compared themselves.  The rows of one
class, shingle, family or hub are dealt out over all tasks wherever they are
counted; only the search of prefixes for shingles of several components (step 4)
sorts the rows of a shingle in one task, and streams them.

Edge cases: null text is empty; documents without words have an empty set and
link with nothing; a long text is split into words a piece at a time; rows with null ids are left out; rows that share an id are
one document, the smallest of the texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import materialise, shuffle_partitions, texts_by_id, with_totals
from .textbuf import LOWER, SLICE_BYTES, column_bytes, lean, mix, slices, space_pieces, word_prints, words

WORDS, PERCENT = 5, 75
#: Documents looked at for the order of shingles, and how many of them make a shingle widespread.
ORDER_SAMPLE, WIDESPREAD, ORDER_TOKENS = 4096, 8, 50_000
#: Documents and shingles in a block of step 3; rows in a group of step 4 that one task searches.
BLOCK_DOCS, BLOCK_SHINGLES, GROUP_ROWS = 64, 2_000_000, 4000
FIRST = 3
#: Ids are broadcast as a filter up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
LEAF = 16
#: Words of one text whose shingles are made at once.
SLICE_WORDS = 500_000
_LOWER = LOWER.tobytes()
#: Rows of an Arrow batch that are Python objects at once.
DECODED_ROWS = 256


def _word_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and how many each text has."""

    def of(data, offsets):
        data = LOWER[data]
        start, end, row = words(data, offsets)
        return word_prints(data, start, end), np.bincount(row, minlength=len(offsets) - 1)

    if len(offsets) > 2 or len(data) <= SLICE_BYTES:
        return of(data, offsets)
    word = np.concatenate([of(data[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in space_pieces(data)])
    return word, np.array([len(word)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of all texts one after another, and where each text's begin."""
    rows = len(offsets) - 1
    word, count = _word_prints(data, offsets)
    if len(word) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    if rows == 1 and len(word) > SLICE_WORDS:
        parts = [np.unique(_shingles(word[i : i + SLICE_WORDS + n - 1], np.array([min(SLICE_WORDS + n - 1, len(word) - i)]), n)[0]) for i in range(0, len(word) - n + 1, SLICE_WORDS)]
        value = np.unique(np.concatenate(parts))
        return value, np.array([0, len(value)])
    value, row = _shingles(word, count, n)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(rows + 1))


def _shingles(word: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of texts of so many words, in order, and their texts."""
    row = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    value = np.zeros(len(word), np.uint64)
    fewer = np.minimum(count, n)[row]
    left = first[row] + count[row] - np.arange(len(word))
    for k in range(n):
        use = (k < fewer) & (k < left)
        at = np.minimum(np.arange(len(word)) + k, len(word) - 1)
        value = np.where(use, mix(value * np.uint64(0xD1342543DE82EF95) + word[at] + np.uint64(k + 1)), value)
    keep = (left >= n) | ((count[row] < n) & (np.arange(len(word)) == first[row]))
    return value[keep], row[keep]


def set_list(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """The shingle set of each text, found a few MB of text at a time."""
    data, offsets = column_bytes(pa.array(texts, pa.large_string()))
    out = []
    for i, j in slices(offsets):
        flat, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
        out += [flat[a:b].copy() for a, b in zip(at[:-1], at[1:])]
    return out


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles of a set of n of which any linked set has at least one."""
    return n - (percent * n + 99) // 100 + 1


def bitmap(tokens: np.ndarray, spare: int = 2) -> np.ndarray:
    """A power of two of bits, at least ``spare`` for a token; half as wide a bitmap is the OR of its halves."""
    width = max(64, 1 << int(spare * len(tokens) - 1).bit_length())
    bits = np.zeros(width // 8, np.uint8)
    at = (tokens & np.uint64(width - 1)).astype(np.int64)
    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return bits.view(np.uint64)


class Tree:
    """A signature tree over sets, neighbours alike: node k covers rows [lo, hi) and has children 2k, 2k + 1."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        self.bits, self.sizes, self.groups = bits, sizes, groups
        self.filled = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.near = np.zeros(len(bits), np.int64)  # bits in common with the row before
        self.near[1:] = np.bitwise_count(bits[1:] & bits[:-1]).sum(axis=1)
        self.nodes: dict[int, tuple] = {}
        self._build(1, 0, len(sizes))

    def _build(self, k: int, lo: int, hi: int) -> None:
        if hi - lo <= LEAF:
            own = np.bitwise_or.reduce(self.bits[lo:hi], axis=0)
        else:
            edge = (hi - lo) // 4
            mid = lo + edge + int(self.near[lo + edge : hi - edge].argmin())  # where neighbours are least alike
            self._build(2 * k, lo, mid)
            self._build(2 * k + 1, mid, hi)
            own = self.nodes[2 * k][2] | self.nodes[2 * k + 1][2]
        g = self.groups[lo:hi]
        self.nodes[k] = lo, hi, own, int(self.filled[lo:hi].min()), int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), int(g[0]) if (g == g[0]).all() else None

    def leaf(self, k: int) -> bool:
        return 2 * k not in self.nodes


def _may_link(overlap, total, percent):
    """Whether sets of together ``total`` members can link with this overlap."""
    return 100 * overlap >= percent * (total - overlap)


def dual_traversal(one: Tree, two: Tree, percent: int, same: bool, seen: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that the bitmaps and sizes allow, in different groups.  same: both trees are one, and each pair comes once.

    seen: counts node pairs that are met, dropped, and compared row by row.
    """
    stack, seen = [(1, 1)], {} if seen is None else seen
    count = lambda what: seen.__setitem__(what, seen.get(what, 0) + 1)
    while stack:
        a, b = stack.pop()
        count("met")
        lo, hi, bits_a, fill_a, least_a, most_a, group_a = one.nodes[a]
        lo2, hi2, bits_b, fill_b, least_b, most_b, group_b = two.nodes[b]
        if 100 * most_a < percent * least_b or 100 * most_b < percent * least_a or group_a is not None and group_a == group_b:
            count("dropped")
            continue
        if a != b or not same:
            common = int(np.bitwise_count(bits_a & bits_b).sum())
            top = min(most_a - max(0, fill_a - common), most_b - max(0, fill_b - common))
            if not _may_link(top, max(least_a, top) + max(least_b, top), percent):
                count("dropped")
                continue
        if one.leaf(a) and two.leaf(b):
            count("compared")
            x, y = one.bits[lo:hi], two.bits[lo2:hi2]
            common = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2).astype(np.int64)
            nx, ny = one.sizes[lo:hi, None], two.sizes[None, lo2:hi2]
            top = np.minimum(nx - (one.filled[lo:hi, None] - common), ny - (two.filled[None, lo2:hi2] - common))
            ok = _may_link(top, nx + ny, percent) & (one.groups[lo:hi, None] != two.groups[None, lo2:hi2])
            if same and a == b:
                ok &= np.arange(lo, hi)[:, None] < np.arange(lo2, hi2)[None, :]
            i, j = np.nonzero(ok)
            if len(i):
                yield i + lo, j + lo2
        elif same and a == b:
            stack += [(2 * a, 2 * a), (2 * a + 1, 2 * a + 1), (2 * a, 2 * a + 1)]
        elif not one.leaf(a) and (two.leaf(b) or hi - lo >= hi2 - lo2):
            stack += [(2 * a, b), (2 * a + 1, b)]
        else:
            stack += [(a, 2 * b), (a, 2 * b + 1)]


def _alike(bits: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """An order by classes of size, and in them by the first bit set, which like sets often share: so the OR of neighbours stays sparse."""
    first = (bits != 0).argmax(1)
    word = bits[np.arange(len(bits)), first]
    low = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1))
    step = np.log(100 / percent) if percent < 100 else 1e-9
    return np.lexsort((sizes, low, first, np.floor(np.log(np.maximum(sizes, 1)) / step)))


def candidate_pairs(bitmaps: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray, percent: int = PERCENT, seen: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of different groups that may link.  Sets of one bitmap width are a tree; linked sets have equal or neighbouring widths."""
    wide = np.array([len(b) for b in bitmaps])
    trees = {}
    for w in sorted(set(wide.tolist())):
        rows = np.flatnonzero(wide == w)
        bits = np.stack([bitmaps[r] for r in rows])
        order = _alike(bits, sizes[rows], percent)
        rows, bits = rows[order], bits[order]
        trees[w] = rows, Tree(bits, sizes[rows], groups[rows])
        for i, j in dual_traversal(trees[w][1], trees[w][1], percent, True, seen):
            yield rows[i], rows[j]
        if w // 2 in trees:
            lower, tree = trees[w // 2]
            folded = Tree(bits[:, : w // 2] | bits[:, w // 2 :], sizes[rows], groups[rows])
            for i, j in dual_traversal(tree, folded, percent, False, seen):
                yield lower[i], rows[j]


def links(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact comparison of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and bool(_may_link(both, len(x) + len(y), percent))


def _plain_words(text: str) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a piece at a time."""
    raw = np.frombuffer(text.encode(), np.uint8)
    for lo, hi in space_pieces(raw):
        yield raw[lo:hi].tobytes().translate(_LOWER).split()


def words_link(a: str, b: str, n: int = WORDS, percent: int = PERCENT) -> bool:
    """The comparison of two texts by their words: words get numbers, pairs of numbers get numbers, up to shingles."""
    number: dict[bytes, int] = {}
    ids = [np.concatenate([np.zeros(0, np.int64), *(np.array([number.setdefault(w, len(number)) for w in part], np.int64) for part in _plain_words(t))]) for t in (a, b)]
    if min(map(len, ids)) < n:
        return len(ids[0]) > 0 and np.array_equal(*ids)
    both = np.concatenate(ids)
    gram, size = both, len(number)
    for k in range(1, n):
        gram = np.unique(gram[: len(both) - k] * size + both[k:], return_inverse=True)[1]
    x, y = np.unique(gram[: len(ids[0]) - n + 1]), np.unique(gram[len(ids[0]) :])
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and bool(_may_link(common, len(x) + len(y), percent))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def _digest(raw: np.ndarray) -> bytes:
    made = hashlib.blake2b(digest_size=16)
    for lo, hi in space_pieces(raw):
        made.update(b" ".join(raw[lo:hi].tobytes().translate(_LOWER).split()) + b" ")
    return made.digest()


def _sets(n: int, percent: int, late: np.ndarray):
    """Of each document: size, digest of the words, prefix in order, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets):
                flat, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                size = np.diff(at)
                heads, maps, keys = [], [], []
                for k in range(j - i):
                    own = flat[at[k] : at[k + 1]]
                    length = prefix_length(len(own), percent) if len(own) else 0
                    if len(late) and length:
                        behind = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
                        heads.append(np.concatenate([own[~behind], own[behind]])[:length].tobytes())
                    else:
                        heads.append(own[:length].tobytes())
                    maps.append(bitmap(own).tobytes() if len(own) else b"")
                    keys.append(_digest(data[offsets[i + k] : offsets[i + k + 1]]))
                first = [np.frombuffer(h[: 8 * FIRST], np.int64).tolist() for h in heads]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(heads, pa.binary()), pa.array(maps, pa.binary())],
                    names=["doc_id", "n", "key", "first", "prefix", "bits"],
                )

    return run


def _widespread(texts: DataFrame, n: int) -> np.ndarray:
    """Shingles that many documents of a bounded sample have, sorted.  They only decide an order."""
    every = max(1, texts.count() // ORDER_SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets):
                flat, _ = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["token"])

    found = some.mapInArrow(lean(run), "token long").groupBy("token").count().filter(F.col("count") >= WIDESPREAD).orderBy(F.desc("count"), "token").limit(ORDER_TOKENS)
    return np.sort(np.array([r.token for r in found.collect()], np.int64).view(np.uint64))


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents, without a shuffle of the others where the ids are few."""
    few = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _consecutive(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, dict[str, list]]]:
    """Rows with equal values in the first columns, which arrive together; a group is as small as its block."""
    key, held = None, None
    for batch in batches:
        names = batch.schema.names
        for at in range(0, batch.num_rows, DECODED_ROWS):
            for row in zip(*batch.slice(at, DECODED_ROWS).to_pydict().values()):
                if row[:keys] != key:
                    if held:
                        yield key, held
                    key, held = row[:keys], {x: [] for x in names[keys:]}
                for x, v in zip(names[keys:], row[keys:]):
                    held[x].append(v)
    if held:
        yield key, held


def _link_blocks(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _consecutive(batches, 2):
            docs = block["doc_id"]
            if len(docs) < 2:
                continue
            texts = block.pop("text")
            sets = set_list(texts, n)
            sizes, union = np.array([len(s) for s in sets]), Union(len(docs))
            for i, j in candidate_pairs([bitmap(s) for s in sets], sizes, np.arange(len(docs)), percent):
                for x, y in zip(i.tolist(), j.tolist()):
                    a, b = union.top(x), union.top(y)
                    if a != b and links(sets[x], sets[y], percent) and words_link(texts[x], texts[y], n, percent):
                        union.join(a, b)
            tops = [union.top(k) for k in range(len(docs))]
            out = [(docs[t], docs[k]) for k, t in enumerate(tops) if t != k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _first_links(texts: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Step 3."""
    spark = texts.sparkSession
    heads = reps.select("doc_id", "n", F.explode("first").alias("token"))
    told = with_totals(heads.withColumn("one", F.lit(1)), ["token"], "doc_id", docs=("one", F.sum), shingles=("n", F.sum)).filter("docs > 1")
    parts = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES))
    blocks = materialise(told.select("token", "doc_id", F.pmod(F.xxhash64("doc_id", "token"), parts).alias("block")), "blocks")
    members = _only(texts, blocks.select("doc_id").distinct()).join(blocks, "doc_id").select("token", "block", "doc_id", "text")
    dealt = members.repartition(shuffle_partitions(spark), "token", "block").sortWithinPartitions("token", "block", "doc_id")
    return dealt.mapInArrow(lean(_link_blocks(n, percent)), "a long, b long").distinct()


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(3))
        at = offsets >> 3
        doc, comp, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        tokens = np.frombuffer(np.ascontiguousarray(data).tobytes(), np.int64)
        step = 200_000
        owner = np.repeat(np.arange(len(doc)), np.diff(at))
        for i in range(0, len(tokens), step):
            o = owner[i : i + step]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[i : i + step]), pa.array(doc[o]), pa.array(comp[o]), pa.array(n[o])], names=["token", "doc_id", "component", "n"])


def _survivors(percent: int):
    """Documents of a block that may link with one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _consecutive(batches, 3):
            maps = [np.frombuffer(b, np.uint64) for b in rows["bits"]]
            docs, comps, side, sizes = (np.array(rows[k], np.int64) for k in ("doc_id", "component", "side", "n"))
            live = np.zeros(len(docs), bool)
            for i, j in candidate_pairs(maps, sizes, comps, percent):
                ok = (side[i] != side[j]) | (key[1] == key[2])
                live[i[ok]] = live[j[ok]] = True
            if live.any():
                n = int(live.sum())
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * n, t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))), pa.array(side[live].astype(np.int32)), pa.array(docs[live]), pa.array(comps[live])], names=["family", "x", "y", "side", "doc_id", "component"])

    return run


def _link_families(n: int, percent: int):
    """Links between components, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), rows in _consecutive(batches, 3):
            docs, comps, side = (np.array(rows[k], np.int64) for k in ("doc_id", "component", "side"))
            texts = rows.pop("text")
            sets = set_list(texts, n)
            _, own = np.unique(comps, return_inverse=True)
            union, out = Union(int(own.max()) + 1), []
            for i, j in candidate_pairs([bitmap(s, 8) for s in sets], np.array([len(s) for s in sets]), comps, percent):
                ok = (side[i] != side[j]) | (x == y)
                for p, q in zip(i[ok].tolist(), j[ok].tolist()):
                    a, b = union.top(int(own[p])), union.top(int(own[q]))
                    if a != b and links(sets[p], sets[q], percent) and words_link(texts[p], texts[q], n, percent):
                        union.join(a, b)
                        out.append((int(docs[p]), int(docs[q])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _later_links(texts: DataFrame, sets: DataFrame, placed: DataFrame, n: int, percent: int) -> DataFrame:
    """Steps 4 and 5.  placed: (doc_id, component, n, prefix) of each class."""
    parts = shuffle_partitions(sets.sparkSession)
    rows = placed.select("doc_id", "component", "n", "prefix").mapInArrow(lean(_prefix_rows), "token long, doc_id long, component long, n long")
    token = Window.partitionBy("token")
    mixed = rows.withColumn("lo", F.min("component").over(token)).withColumn("hi", F.max("component").over(token)).withColumn("family", F.min("doc_id").over(token)).filter("lo < hi")
    mixed = mixed.select("family", "doc_id", "component", "n").distinct()
    mixed = with_totals(mixed.withColumn("one", F.lit(1)), ["family"], "doc_id", docs=("one", F.sum), shingles=("n", F.sum))
    blocks = F.ceil(F.greatest(F.col("docs") / GROUP_ROWS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = materialise(mixed.select("family", "doc_id", "component", "n", blocks.alias("blocks")), "families")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = mixed.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", other)
    dealt = dealt.select("family", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "doc_id", "component", "n")
    bits = _only(sets.select("doc_id", "bits"), mixed.select("doc_id").distinct())
    told = dealt.join(bits, "doc_id").select("family", "x", "y", "side", "doc_id", "component", "n", "bits")
    live = told.repartition(parts, "family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(lean(_survivors(percent)), "family long, x int, y int, side int, doc_id long, component long")
    live = materialise(live, "live")
    full = _only(texts, live.select("doc_id").distinct()).join(live, "doc_id").select("family", "x", "y", "side", "doc_id", "component", "text")
    return full.repartition(parts, "family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(lean(_link_families(n, percent)), "a long, b long")


def near_duplicate_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_id (the smallest doc_id with the same words)."""
    texts = texts_by_id(docs, id_col, text_col)
    late = _widespread(texts, n)
    sets = materialise(texts.mapInArrow(lean(_sets(n, percent, late)), "doc_id long, n long, key binary, first array<long>, prefix binary, bits binary"), "sets")
    some = sets.filter("n > 0")
    classes = materialise(with_totals(some.select("doc_id", "key"), ["key"], "doc_id", class_id=("doc_id", F.min)).select("doc_id", "class_id"), "classes")
    copies = classes.filter("doc_id != class_id")
    lone = lambda frame: frame.join(_maybe_broadcast(copies.select("doc_id")), "doc_id", "left_anti")
    edges = materialise(_first_links(texts, lone(some.select("doc_id", "n", "first")), n, percent), "links")
    found = components(edges)
    placed = lone(some.select("doc_id", "n", "prefix")).join(_maybe_broadcast(found.withColumnRenamed("id", "doc_id")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = materialise(_later_links(texts, sets, placed, n, percent), "links")
    if more.limit(1).count():
        found = components(edges.unionByName(more))
    merged = sets.select("doc_id", F.col("n").alias("n_shingles")).join(classes, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return merged.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")


def _maybe_broadcast(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_IDS else frame
