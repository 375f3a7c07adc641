"""Operator 3: repeated windows by a depth-limited radix sort of suffixes.

Every byte is removed that lies in a ``depth``-byte string which also starts
earlier (in a smaller doc_id, or earlier in the same document).  The suffixes of
all texts, cut off after ``depth`` bytes, are put in order by most-significant-
digit passes; a suffix whose group has become single drops out, and what is
still together after the last digit is equal through ``depth`` bytes, by
content: exactly the repeated windows.

1. A lossless filter stands before the passes.  The *anchor* of a window is the
   ``gram``-byte string in it with the least fingerprint, the leftmost of equal
   ones.  It depends on the window's bytes only, so equal windows share it.
   Neighbouring windows mostly have the same one: a run of windows with one anchor
   is one row, about 3 rows in 100 bytes, and no two windows of a run are equal.
   Rows are dealt out by the anchor's fingerprint; a row that is alone drops out.
2. The bytes of the runs that are left are brought together by anchor.  Of runs
   with the same bytes all but the earliest are removed as they are.
3. Where different runs share an anchor, their windows are sorted by digits of
   eight bytes, the most significant first; single ones drop out after each pass.
4. An anchor with more than PART_ROWS runs is dealt out in parts of so many.  Each
   is settled by itself, and the windows that are the first of their part meet once
   more, dealt out by a fingerprint and compared by their bytes.

Before anything is shuffled, a task compares the runs that it has by their bytes
and keeps the earliest of each, so a string that a third of all documents hold
arrives once per task and not once per document.

Edge cases: null text is empty; rows with null ids are left out; rows that share
an id are one document, the smallest of the texts; texts under ``depth`` bytes
lose nothing; matches never cross documents; one long text is looked at in blocks
that overlap; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialise, shuffle_partitions, texts_by_id
from .textbuf import RollingHash, column_bytes, lean, mix, ranges, slices

DEPTH, GRAM = 100, 32
#: Low bits of a gram's rank that hold its place; window starts looked at in one go are fewer.
PLACE_BITS = 22
BLOCK = 1 << 19
#: Rows that a task gathers before it looks for copies among them.
LOCAL_ROWS = 400_000
#: Bytes of runs that a task compares at once, and rows of one anchor that stay together.
GROUP_BYTES, PART_ROWS = 4 << 20, 30_000
#: Anchors with several parts are broadcast up to this many (8 bytes each).
BROADCAST_ANCHORS = 500_000
SPANS = "digit long, part int, many boolean, doc_id long, start int, span binary"
#: kind: 0 a run to compare, 1 bytes to remove.
ROWS = "digit long, part int, doc_id long, start int, len int, kind int"
WINDOWS = "digit long, tail long, doc_id long, start int, len int, span binary"


def anchor_runs(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: row, first start in the text, number of starts, and the anchor's fingerprint."""
    parts = []
    for i, j in slices(offsets):
        base, stop = int(offsets[i]), int(offsets[j])
        for block in range(base, stop, BLOCK):
            end = min(stop, block + BLOCK + depth - 1)  # one long text: blocks overlap by a window less a byte
            if end - block >= depth:
                parts.append(_block_runs(data[block:end], offsets[i : j + 1] - block, i, depth, gram))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _block_runs(data, bounds, first_row, depth, gram):
    prints = RollingHash(data).grams(gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    rank = (prints & ~low) | np.arange(len(prints), dtype=np.uint64)
    width, have = depth - gram + 1, 1
    while have < width:  # least rank of ever longer stretches
        step = min(have, width - have)
        rank = np.minimum(rank[:-step], rank[step:])
        have += step
    anchor = (rank & low).astype(np.int64)  # of the window that starts there
    starts = np.arange(len(anchor), dtype=np.int64)
    row = np.searchsorted(bounds, starts, "right") - 1
    whole = starts + depth <= bounds[np.minimum(row + 1, len(bounds) - 1)]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    heads = np.flatnonzero(new & whole)
    if len(heads) == 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    stops = np.cumsum(whole)
    after = np.append(np.flatnonzero(new), len(anchor))
    count = stops[after[np.searchsorted(after, heads, "right")] - 1] - stops[heads] + 1
    return row[heads] + first_row, heads - bounds[row[heads]], count, prints[anchor[heads]]


def equal_windows(data: np.ndarray, place: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the windows of a group that begin at ``place``: the windows that have equals, and a number for each set of equals."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    left = np.arange(len(place))
    for at in range(0, depth, 8):
        digit = np.ascontiguousarray(eight[place[left] + at]).view(">u8")[:, 0].astype(np.uint64)
        if depth - at < 8:
            digit >>= np.uint64(8 * (8 - (depth - at)))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        together = np.bincount(number)[number] > 1 if len(left) else new
        left, group = left[together], number[together]
        if len(left) == 0:
            break
    return left, group


def _later(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows are not the earliest of their group."""
    order = np.lexsort((start, doc, group))
    same = np.zeros(len(order), bool)
    same[1:] = group[order][1:] == group[order][:-1]
    return order[same]


def _copies(digit: np.ndarray, doc: np.ndarray, start: np.ndarray, texts) -> np.ndarray:
    """Rows whose bytes an earlier row of the same anchor has; texts: the bytes of rows."""
    order = np.lexsort((start, doc, digit))
    same = digit[order][1:] == digit[order][:-1]
    near = np.zeros(len(order), bool)
    near[1:] |= same
    near[:-1] |= same
    order = order[near]
    seen: set[tuple[int, bytes]] = set()
    lose = [k for k, key in zip(order.tolist(), zip(digit[order].tolist(), texts(order))) if key in seen or seen.add(key)]
    return np.array(lose, np.int64)


def _merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Stretches of bytes joined where they touch or overlap."""
    if len(doc) == 0:
        return doc, start, length
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + length)[order]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], np.maximum.reduceat(end, heads) - start[heads]


def _batch(digit, part, doc, start, length, kind) -> pa.RecordBatch:
    as_long = pa.array(np.ascontiguousarray(digit).astype(np.uint64).view(np.int64) if digit.dtype != np.int64 else digit)
    n = len(doc)
    columns = [as_long, pa.array(np.broadcast_to(np.asarray(part, np.int32), n).copy()), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(length, np.int32)), pa.array(np.full(n, kind, np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["digit", "part", "doc_id", "start", "len", "kind"])


def _removed(doc, start, length) -> pa.RecordBatch:
    doc, start, length = _merged(doc, start, length)
    return _batch(mix(doc.astype(np.uint64)), 0, doc, start, length, 1)  # removed bytes pass the next shuffle anywhere


def _runs(depth: int, gram: int):
    """The runs of each text; of those with the same bytes that a task has at once, the earliest, and the bytes of the others as removed."""

    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        digit, doc, start, length, at = (np.concatenate([h[k] for h in held]) for k in range(5))
        buffer = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        raw = [h[5].tobytes() for h in held]
        texts = lambda rows: (raw[b][p : p + n] for b, p, n in zip(buffer[rows].tolist(), at[rows].tolist(), length[rows].tolist()))
        lose = _copies(digit, doc, start, texts)
        keep = np.ones(len(digit), bool)
        keep[lose] = False
        keep = np.flatnonzero(keep)
        for i in range(0, len(keep), 50_000):
            k = keep[i : i + 50_000]
            yield _batch(digit[k], 0, doc[k], start[k], length[k], 0)
        if len(lose):
            yield _removed(doc[lose], start[lose], length[lose])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets):
                mine = data[offsets[i] : offsets[j]]
                row, start, count, digit = anchor_runs(mine, offsets[i : j + 1] - offsets[i], depth, gram)
                held.append((digit, ids[i + row], start, count + depth - 1, start + (offsets[i + row] - offsets[i]), mine))
                rows += len(row)
                if rows >= LOCAL_ROWS:
                    yield from settled(held)
                    held, rows = [], 0
        yield from settled(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of the anchor: those that are not alone, numbered in parts, and removed bytes as they are.  Of the open group only its first row is held."""
    open_, count, first = None, 0, None  # anchor of the open group, rows given out, its first row while it is alone
    for batch in batches:
        digit, _, doc, start, length, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        done = kind == 1
        if done.any():
            yield _batch(digit[done], 0, doc[done], start[done], length[done], 1)
            digit, doc, start, length = (x[~done] for x in (digit, doc, start, length))
        if first is not None:
            digit, doc, start, length = (np.concatenate([[f], x]) for f, x in zip(first, (digit, doc, start, length)))
        if len(digit) == 0:
            continue
        new = np.ones(len(digit), bool)
        new[1:] = digit[1:] != digit[:-1]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        place = np.arange(len(digit)) - heads[group]
        size = np.bincount(group)
        carried = 0 if first is not None or open_ is None or digit[0] != open_ else count
        place[group == 0] += carried
        out = (size > 1)[group] | ((group == 0) & (carried > 0))
        tail = group == group[-1]
        alone = bool(tail.sum() == 1 and not out[-1])
        if out.any():
            yield _batch(digit[out], place[out] // PART_ROWS, doc[out], start[out], length[out], 0)
        open_, count = digit[-1], int(place[-1]) + 1
        first = (digit[-1], doc[-1], start[-1], length[-1]) if alone else None


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of runs whose anchor other runs have as well; a text comes with all of its runs."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = column_bytes(batch.column(1))
        runs = batch.column(2)
        owner = np.repeat(np.arange(len(ids)), np.diff(runs.offsets.to_numpy()))
        start, length, digit, part, many = (runs.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("start", "len", "digit", "part", "many"))
        for a in range(0, len(owner), 20_000):
            k = slice(a, a + 20_000)
            span = _binary(data, start[k] + offsets[owner[k]], length[k].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digit[k]), pa.array(part[k]), pa.array(many[k]), pa.array(ids[owner[k]]), pa.array(start[k]), span], names=["digit", "part", "many", "doc_id", "start", "span"])


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data[ranges(start, size)].tobytes())])


def _windows_batch(digit, tail, doc, start, length, span) -> pa.RecordBatch:
    n = len(doc)
    arrays = [pa.array(digit), pa.array(tail), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(length, np.int32)), span if span is not None else pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["digit", "tail", "doc_id", "start", "len", "span"])


def _settle_windows(depth: int):
    """Rows in order of anchor and part: bytes to remove (span null), and of anchors with several parts the first windows of each."""

    def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = column_bytes(rows["span"])
        digit, part, many, doc, start = (rows[k].to_numpy() for k in ("digit", "part", "many", "doc_id", "start"))
        size, raw = np.diff(offsets), data.tobytes()
        _, digit_part = np.unique(np.stack([digit, part.astype(np.int64)]), axis=1, return_inverse=True)
        lose = _copies(digit_part.ravel(), doc, start, lambda rows: (raw[a:b] for a, b in zip(offsets[rows].tolist(), offsets[rows + 1].tolist())))
        gone = [(doc[lose], start[lose].astype(np.int64), size[lose])]
        keep = np.ones(len(digit), bool)
        keep[lose] = False
        group = digit_part.ravel()
        several = np.bincount(group[keep], minlength=group.max() + 1)[group] > 1
        runs = np.flatnonzero(keep & (several | many))
        each = size[runs] - depth + 1
        place, who = ranges(offsets[runs], each), np.repeat(runs, each)
        at = place - offsets[who] + start[who]
        left, same = equal_windows(data, place, group[who], depth)
        later = left[_later(same, doc[who[left]], at[left])]
        gone.append((doc[who[later]], at[later], np.full(len(later), depth, np.int64)))
        yield from _gone(gone)
        first = many[who].astype(bool)
        first[later] = False
        first = np.flatnonzero(first)
        if len(first):
            tail = RollingHash(data).of(place[first], place[first] + depth).view(np.int64)
        for i in range(0, len(first), 20_000):
            k = first[i : i + 20_000]
            n = np.full(len(k), depth, np.int64)
            yield _windows_batch(digit[who[k]], tail[i : i + 20_000], doc[who[k]], at[k], n, _binary(data, place[k], n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(5).nbytes
            if size < GROUP_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            digit, part = rows["digit"].to_numpy(), rows["part"].to_numpy()
            cut = len(digit) - int(((digit == digit[-1]) & (part == part[-1])).sum())
            if cut:
                yield from settled(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            size = sum(x.column(5).nbytes for x in held)
        if held:
            yield from settled(pa.Table.from_batches(held))

    return run


def _gone(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    doc, start, length = _merged(*(np.concatenate(x) for x in zip(*parts)))
    if len(doc):
        yield _windows_batch(doc, doc, doc, start, length, None)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of anchor, fingerprint, bytes and place: all but the first of equal bytes."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()))
        lose = np.array([k for k, key in enumerate(keys) if key == (keys[k - 1] if k else last)], np.int64)
        last = keys[-1] if keys else last
        doc, start, length = (batch.column(c).to_numpy(zero_copy_only=False)[lose].astype(np.int64) for c in (2, 3, 4))
        yield from _gone([(doc, start, length)])


def spans_by_document(texts: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, spans array<struct<start,len>>) of every document; texts: unique (doc_id, text).  Spans may overlap."""
    n = shuffle_partitions(texts.sparkSession)
    runs = texts.mapInArrow(lean(_runs(depth, gram)), ROWS).repartition(n, "digit").sortWithinPartitions("digit", "doc_id", "start")
    second = materialise(runs.mapInArrow(lean(_shared), ROWS), "runs")
    dealt = texts.repartition(n, "doc_id")
    shared = second.filter("kind = 0")
    large = materialise(shared.filter("part = 1").select("digit").distinct().withColumn("many", F.lit(True)), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_ANCHORS else large
    told = shared.join(large, "digit", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    some = told.groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "digit", "part", "many")).alias("runs"))
    spans = dealt.join(some, "doc_id").select("doc_id", "text", "runs").mapInArrow(lean(_spans), SPANS)
    third = spans.repartition(n, "digit", "part").sortWithinPartitions("digit", "part", "doc_id", "start").mapInArrow(lean(_settle_windows(depth)), WINDOWS)
    third = materialise(third, "windows")
    last = third.filter("span is not null").repartition(n, "digit", "tail").sortWithinPartitions("digit", "tail", "span", "doc_id", "start").mapInArrow(lean(_compare), WINDOWS)
    gone = second.filter("kind = 1").select("doc_id", "start", "len").unionByName(third.filter("span is null").select("doc_id", "start", "len")).unionByName(last.select("doc_id", "start", "len"))
    mine = gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    none = F.array().cast("array<struct<start:int,len:int>>")
    return dealt.join(mine, "doc_id", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Row, kept bytes, and the maximal removed stretches of each text."""
    data, offsets = column_bytes(batch.column(1))
    spans = batch.column(2)
    at, flat = spans.offsets.to_numpy(), spans.flatten()
    owner = np.repeat(np.arange(len(batch)), np.diff(at)).astype(np.int64)
    owner, start, length = _merged(owner, *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "len")))
    lo = np.searchsorted(owner, np.arange(len(batch) + 1))
    for k in range(len(batch)):
        text = data[offsets[k] : offsets[k + 1]]
        s, n = start[lo[k] : lo[k + 1]], length[lo[k] : lo[k + 1]]
        if len(s):
            edges = np.zeros(len(text) + 1, np.int32)
            edges[s] += 1
            edges[s + n] -= 1
            text = text[np.cumsum(edges[:-1]) == 0]
        yield k, text.tobytes(), s, n


def remove_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (the remaining text; part of a character that a cut leaves is dropped), n_bytes, n_removed, n_spans, kept_sha256 (of the bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part, out = batch.slice(i, 500), []
                for _, kept, _, n in _cut(part):
                    gone = int(n.sum())
                    out.append((kept.decode("utf-8", "ignore"), len(kept) + gone, gone, len(n), hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = spans_by_document(texts_by_id(docs, id_col, text_col), depth, min(GRAM, depth))
    return spans.mapInArrow(lean(run), "doc_id long, kept string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
