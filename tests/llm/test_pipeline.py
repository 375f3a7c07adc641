import hashlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as groups
from tokenizers import Tokenizer


def cut(rows, depth=100):
    """What is left of each text, and how much went."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - depth + 1):
            if (w := raw[i : i + depth]) in seen:
                gone[i : i + depth] = True
            seen.add(w)
        out[doc] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore"), int(gone.sum())
    return out


def test_stages_like_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (docs, after))
        assert set(new) <= set(old)
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 0}
            assert len(bad & set(new)) <= 1 and len(set(old) - set(new) - bad) < 0.2 * len(old)
        elif name == "near_duplicates":
            assert set(new) == {d for d, (_, c) in groups(list(old.items())).items() if d == c}
        elif name == "repeated_passages":
            want = cut(old.items())
            assert new == {d: (text if gone else old[d]) for d, (text, gone) in want.items() if not gone or text} and any(g for _, g in want.values())
            assert all(r.n_chars == len(r.text) for r in after.collect() if want[r.doc_id][1])
        elif name == "decontamination":
            assert set(new) == set(old) - {x[0] for x in leaks(old.items(), items)}
        docs = after
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in P.tokens(spark, docs, sf).collect()}
    ids = {d: np.array(lib.encode(t, add_special_tokens=False).ids, "<u4") for d, t in texts.items()}
    assert got == {d: (len(x), hashlib.sha256(x.tobytes()).hexdigest()) for d, x in ids.items()}


def test_odd_rows_and_clashing_names(spark):
    sf = "/root/testdata/sf0.001"
    names = ["kept", "n_removed", "n_bytes", "component_id", "row", "score", "token", "_lost", "item_id", "predicted"]
    text = " ".join(f"w{i}" for i in range(60))
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = ("".join(p[x] for x in bits) for p in ("ab", "ba"))
    rows = [(1, text), (2, text), (2, "other words than those of the first one"), (3, None), (4, ""), (None, text), (None, "x"), (5, text + " and more"), (5, text + " and more"), (6, a), (7, b), (8, "say " + text[:160] + " again " * 3 + "z")]
    rows = [(d, t, "en", "s", len(t or ""), *("c" * len(names))) for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame(rows, schema).repartition(3)
    one = {1: text, 2: "other words than those of the first one", 3: None, 4: "", 5: text + " and more", 6: a, 7: b, 8: rows[-1][1]}
    got = P.quality(spark, df, sf)
    assert got.columns == df.columns and {r[0] for r in got.collect()} <= {r[0] for r in rows}
    got = P.near_duplicates(spark, df, sf)
    assert got.columns == df.columns and sorted((r.doc_id, r.text or "", r.kept) for r in got.collect()) == sorted((d, t or "", "c") for d, t in one.items() if d != 5)
    got = P.repeated_passages(spark, df, sf)
    want = {d: (left if gone else one[d]) for d, (left, gone) in cut(one.items()).items() if left or not gone}
    assert got.columns == df.columns and {r.doc_id: r.text for r in got.collect()} == want and got.count() == len(want)
    got = P.decontamination(spark, df, sf)
    assert got.columns == df.columns and got.count() == len(rows)
    assert P.tokens(spark, df, sf).count() == len(rows)
    ids = {r.doc_id: r.ids_sha256 for r in P.tokens(spark, df.filter("doc_id in (6, 7)").coalesce(1), sf).collect()}
    assert ids[6] != ids[7]
    empty = df.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).collect() == []
