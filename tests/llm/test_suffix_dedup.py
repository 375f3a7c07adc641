import hashlib
import random

import numpy as np
import pyarrow as pa

from tidemark.llm import suffix_dedup as S
from tidemark.llm.suffix_dedup import remove_repeats


def brute(rows, depth):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            if (w := raw[i : i + depth]) in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, depth=100):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, depth).collect()}
    assert got == brute(rows, depth)


def test_passes_find_equal_windows_only():
    rng = np.random.default_rng(3)
    for depth in (1, 7, 8, 9, 20):
        data = rng.choice(np.frombuffer(b"ab\x00\xff", np.uint8), 400)
        place, group = rng.integers(0, 400 - depth, 150), rng.integers(0, 3, 150)
        left, same = S.equal_windows(data, place, group, depth)
        sets = {}
        for k in range(150):
            sets.setdefault((int(group[k]), data[place[k] : place[k] + depth].tobytes()), set()).add(k)
        assert {frozenset(left[same == g].tolist()) for g in np.unique(same)} == {frozenset(v) for v in sets.values() if len(v) > 1}


def test_texts_that_a_polynomial_confuses(spark):
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = ("".join(p[x] for x in bits) for p in ("ab", "ba"))
    check(spark, [(1, a), (2, b), (3, a + b), (4, "c" + b), (5, None)], 600)


def rows_of():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(40), text(120)
    rows = [(i, text(rng.randint(0, 90))) for i in range(40)]
    rows += [(100 + i, text(10) + passage + text(rng.randint(0, 20))) for i in range(30)]
    rows += [(200 + i, base) for i in range(10)]
    for i in range(40):
        w = base.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        rows.append((300 + i, " ".join(w)))
    rows += [(400, "a" * 1000), (401, "ab" * 300), (402, "a" * 99), (403, "a" * 100), (404, None), (405, ""), (406, passage * 3)]
    return rows


def test_copies_edits_and_passages(spark):
    check(spark, rows_of())
    check(spark, rows_of(), 40)


def by_hand(rows, depth, gram, chunk):
    """The operator's steps in this process, with pyarrow's sort for Spark's shuffles: the removed bytes, and how many windows met again."""

    def dealt(batches, *keys):
        table = pa.Table.from_batches(batches)
        at = sorted(range(len(table)), key=lambda k: [table[c][k].as_py() or b"" if c == "span" else table[c][k].as_py() for c in keys])
        return iter(table.take(pa.array(at, pa.int64())).to_batches(max_chunksize=chunk))

    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] or "" for r in rows]})
    runs = list(S._runs(depth, gram)(iter([texts.slice(i, 9) for i in range(0, len(rows), 9)])))
    second = list(S._shared(dealt(runs, "digit", "doc_id", "start")))
    table = pa.Table.from_batches(second).to_pylist()
    large = {r["digit"] for r in table if r["part"] == 1}
    mine = {}
    for r in table:
        if r["kind"] == 0:
            mine.setdefault(r["doc_id"], []).append({k: r[k] for k in ("start", "len", "digit", "part")} | {"many": r["digit"] in large})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("digit", pa.int64()), ("part", pa.int32()), ("many", pa.bool_())]))
    told = pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int64()), pa.array([dict(rows)[d] for d in mine], pa.string()), pa.array(list(mine.values()), kind)], names=["doc_id", "text", "runs"])
    third = list(S._settle_windows(depth)(dealt(list(S._spans(iter([told]))), "digit", "part", "doc_id", "start")))
    again = [r for r in pa.Table.from_batches(third).to_pylist() if r["span"] is not None]
    last = list(S._compare(dealt([pa.RecordBatch.from_pylist(again, third[0].schema)], "digit", "tail", "span", "doc_id", "start"))) if again else []
    gone = [(r["doc_id"], r["start"], r["len"]) for r in table if r["kind"] == 1]
    gone += [(r["doc_id"], r["start"], r["len"]) for b in third + last for r in b.to_pylist() if r["span"] is None]
    return {(d, i) for d, s, n in gone for i in range(s, s + n)}, len(again)


def test_groups_too_large_for_a_task(monkeypatch):
    """One anchor in several parts, batches of a few rows, little held at once."""
    rows, met = rows_of() + [(500 + i, f"{i * 7919} of a very common line in all of them {i * 104729}") for i in range(60)], 0
    for part, local, group, chunk in ((4, 1, 1, 3), (7, 200, 3000, 50), (30_000, 400_000, 4 << 20, 10_000)):
        monkeypatch.setattr(S, "PART_ROWS", part)
        monkeypatch.setattr(S, "LOCAL_ROWS", local)
        monkeypatch.setattr(S, "GROUP_BYTES", group)
        for depth in (40, 100):
            seen, want = set(), set()
            for doc, text in sorted(rows):
                raw = (text or "").encode()
                for i in range(len(raw) - depth + 1):
                    if raw[i : i + depth] in seen:
                        want |= {(doc, k) for k in range(i, i + depth)}
                    seen.add(raw[i : i + depth])
            got, again = by_hand(rows, depth, 32, chunk)
            assert got == want
            met += again
    assert met > 100


def test_long_text_over_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh") for _ in range(1000))
    long = "".join(rng.choice("abcdefgh") for _ in range(4_400_000))
    rows = [(1, long[:100] + part), (2, long), (3, long[2_097_000:2_097_400] + "x" + long[4_194_200:4_194_500] + part[:150])]
    check(spark, rows)


def test_empty_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, digit string")
    assert remove_repeats(empty).collect() == []
    t = "xyz " * 60 + "end of it"
    df = spark.createDataFrame([(None, t, "a"), (1, t, "a"), (1, t, "b"), (2, t, None)], "doc_id long, text string, start string")
    got = {r.doc_id: r.n_removed for r in remove_repeats(df).collect()}
    assert set(got) == {1, 2} and got[2] == len(t) and got[1] < len(t)
