import re

from tidemark.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        own = shingles(t)
        out |= {(d, i, len(s), len(s & own)) for i, x in items if (s := shingles(x)) and 100 * len(s & own) >= 75 * len(s)}
    return out


def rows():
    w = lambda k, n: " ".join(f"w{(k * 7919 + j * j * 31) % 5003}" for j in range(n))
    items = [(i, w(i, 4 + 3 * i)) for i in range(25)] + [(100, "only three words"), (101, None), (102, "!!"), (103, w(3, 13))]
    docs = [(k, w(500 + k, 60) + " " + (items[k % 25][1] or "") + " " + w(900 + k, 80)) for k in range(60)]
    docs += [(200 + k, " ".join(words(items[20][1])[: 30 + k])) for k in range(34)]
    docs += [(300, "Only THREE words"), (301, None), (302, ""), (303, "x " * 40000 + items[9][1].upper().replace(" ", ", "))]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as item_id", "1 as token")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as doc_id")
    return {(r.doc_id, r.item_id, r.n_item, r.n_common) for r in D.contained_items(d, b).collect()}


def test_like_brute_force(spark, monkeypatch):
    docs, items = rows()
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert run(spark, docs, items) == brute(docs, items)


def test_clean_documents_and_empty_tables(spark):
    docs, items = rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    bad = {r[0] for r in brute(docs, items)}
    assert {r.doc_id for r in D.clean_documents(d, b).collect()} == {x for x, _ in docs} - bad
    assert D.contained_items(d.limit(0), b).collect() == [] and D.contained_items(d, b.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, items[9][1]), (1, items[9][1]), (1, items[9][1])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contained_items(twice, b).collect()} == {(1, 9)}
