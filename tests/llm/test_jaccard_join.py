import random

import numpy as np

from tidemark.llm import jaccard_join as J


def shingles(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    comp = {d: d for d in sets}
    top = lambda d: d if comp[d] == d else top(comp[d])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = top(a), top(b)
                comp[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), top(d)) for d in ids}


def rows_of(seed, docs=60, copies=50):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    rows = [(i, " ".join(text(rng.randint(0, 80)))) for i in range(docs)]
    base, passage = text(200), text(60)
    for i in range(copies):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
        rows.append((2000 + i, " ".join(passage + text(rng.randint(5, 90)))))
    rows += [(3000, "A b\tc"), (3001, "a B  c"), (3002, None), (3003, ""), (3004, " \n"), (3005, "x " * 500), (3006, "X " * 9), (3007, "a b"), (3008, "the same five words"), (3009, "the same five words again")]
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicate_components(df).collect()}
    assert got == brute(rows)


def test_components(spark):
    for seed in (1, 2):
        check(spark, rows_of(seed))


def test_groups_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP_ROWS", 20)
    monkeypatch.setattr(J, "BLOCK_DOCS", 4)
    monkeypatch.setattr(J, "ORDER_TOKENS", 1)
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    check(spark, rows_of(3, 20, 70))


def test_tree_keeps_every_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
        for _ in range(4):
            keep = rng.random(len(base)) < rng.choice([1, 0.95, 0.85])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    found = {tuple(sorted(p)) for i, j in J.candidate_pairs([J.bitmap(s) for s in sets], np.array([len(s) for s in sets]), np.arange(len(sets))) for p in zip(i.tolist(), j.tolist())}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if J.links(sets[i], sets[j])}
    assert true <= found and len(found) < 0.1 * len(sets) ** 2


def test_words_that_a_polynomial_confuses(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = ("".join(p[x] for x in bits) for p in ("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, f"{same} {a}"), (6, f"{same} {b}"), (7, f"{a} {a} q r s t"), (8, f"{b} {b} q r s t")]
    check(spark, rows)


def test_links_are_of_words_and_not_of_fingerprints(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "A b", "a b c d e", "A b C d e"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(120)]
    for x in texts:
        for y in texts:
            p, q = shingles(x), shingles(y)
            assert J.words_link(x, y) == bool(p and q and 100 * len(p & q) >= 75 * len(p | q))
    monkeypatch.setattr(J, "word_prints", lambda data, start, end: np.ones(len(start), np.uint64))  # every word looks the same
    got = list(J._link_blocks(5, 75)(iter([J.pa.RecordBatch.from_pydict({"token": [1] * 3, "block": [0] * 3, "doc_id": [1, 2, 3], "text": ["a b c d e f", "g h i j k l", "a b c d e f"]})])))
    assert [(x["a"], x["b"]) for b in got for x in b.to_pylist()] == [(1, 3)]


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["a", "bb", "ccc", "x" * 300]) for _ in range(2000))
    data, at = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole = J.shingle_sets(data, at)[0]
    assert len(whole) == len(shingles(text))
    with monkeypatch.context() as m:
        m.setattr(J, "SLICE_BYTES", 100)
        m.setattr(J, "SLICE_WORDS", 37)
        m.setattr(J.space_pieces, "__defaults__", (64,))
        assert (J.shingle_sets(data, at)[0] == whole).all()
        digest = J._digest(data)
    assert digest == J._digest(np.frombuffer(("\n" + text.replace(" ", " \t ")).upper().encode(), np.uint8))


def test_trees_drop_most_node_pairs():
    """Families of near copies: how many pairs of nodes are met, dropped and compared row by row."""
    rng, sets = np.random.default_rng(7), []
    for _ in range(100):
        base = rng.integers(0, 2**63, rng.integers(60, 400), dtype=np.uint64)
        for _ in range(16):
            sets.append(np.unique(base[rng.random(len(base)) < 0.97]))
    sizes, seen = np.array([len(s) for s in sets]), {}
    found = {tuple(sorted(p)) for i, j in J.candidate_pairs([J.bitmap(s) for s in sets], sizes, np.arange(len(sets)), seen=seen) for p in zip(i.tolist(), j.tolist())}
    assert {(i, j) for f in range(0, len(sets), 16) for i in range(f, f + 16) for j in range(i + 1, f + 16) if J.links(sets[i], sets[j])} <= found
    leaves = len(sets) // J.LEAF
    print(seen, "of", leaves * (leaves + 1) // 2, "pairs of leaves")
    assert seen["dropped"] > seen["met"] / 5 and seen["compared"] < leaves * (leaves + 1) / 4, seen


def test_other_columns_and_one_hot_shingle(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_DOCS", 4)
    rows = [(i, f"the same five words here w{i} x{i} y{i % 3}", i, "k", "c") for i in range(60)] + [(100 + i, "all of us are copies of one", 1, None, "") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, key string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicate_components(df).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def test_empty_and_repeated_rows(spark):
    assert J.near_duplicate_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e F")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.near_duplicate_components(df).collect()) == [(7, 7), (9, 7)]
