import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np

from tidemark.llm import langid, quality

SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.score_documents(docs, quality.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and len(held) > 300
    assert np.mean([r.predicted == y for r, y in held]) > 0.99
    assert np.mean([r.predicted for r, y in held if y == 1]) > 0.995


def test_quality_does_not_see_labels_or_ids(spark):
    rows = [(i, ("good words in order " if i % 2 else "BUY!! NOW!! ") * (3 + i % 7), "en", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    ranker = quality.train(docs, labels)
    odd = spark.createDataFrame([(None, "good words in order"), (3, "good words in order"), (4, None), (5, ""), (6, "x" * 500_000), (6, "\n\n")], "doc_id long, text string")
    got = quality.score_documents(odd, ranker).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got[:2]}) == 1 and got[0].held_out is False
    assert [r.score for r in quality.score_documents(odd, quality.train(docs, labels.limit(0))).collect()] == [0.5] * 6
    assert quality.score_documents(odd.limit(0), ranker).collect() == []
    kept = quality.keep_good(docs, ranker)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {1}


def test_quality_cuts_by_all_labelled_rows(spark):
    rng = np.random.default_rng(5)
    clean = rng.uniform(0, 1, 1500)
    rows = [(i, " ".join("good" if u < c else "BUY!!" for u in rng.uniform(0, 1, 60))) for i, c in enumerate(clean)]
    marks = [(i, int(c + rng.normal(0, 0.3) > 0.5)) for i, c in enumerate(clean)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    ranker = quality.train(docs, labels, per_label=40)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, ranker).collect()}
    seen = sorted((got[i], y) for i, y in marks if zlib.crc32(str(i).encode()) % 5)
    wrong = lambda cut: sum((s >= cut) != y for s, y in seen)
    assert wrong(quality.CUT) <= min(wrong(s) for s, _ in seen) + 1


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    held = [(got[r.doc_id], r.lang) for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held)
    assert np.mean([r.lang_pred == y for r, y in held]) > 0.97


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3000)
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "é"), (None, "the of and"), (4, "the"), (5, "the and of " * 100_000)], "doc_id long, text string")
    got = [(r.lang_pred, r.score, r.rejected) for r in langid.identify(odd, model).collect()]
    assert got[:3] == [("und", 0.0, True)] * 3 and all(x[0] in model.languages and 0 < x[1] <= 1 for x in got[3:])
    assert got[4][0] == got[6][0] == "en"
    nothing = langid.train(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).collect() == []


def test_pieces_of_long_texts_count_the_same(monkeypatch):
    rng = np.random.default_rng(9)
    for text in (b"One two  two\n three!! " * 40, b"x" * 3000, b" " * 700 + b"a", bytes(rng.choice(list(b"ab ,\n!Z"), 4000).astype(np.uint8))):
        data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        whole, (total, number) = quality.features(data, at), langid.bucket_counts(data, at)
        with monkeypatch.context() as m:
            m.setattr(quality, "SLICE_BYTES", 100)
            m.setattr(quality.space_pieces, "__defaults__", (64,))
            m.setattr(langid, "PIECE_BYTES", 77)
            assert np.allclose(whole, quality.features(data, at))
            parts, n = langid.bucket_counts(data, at)
            assert (parts == total).all() and (n == number).all()


def test_logits_are_means_of_rows():
    """Against a plain loop over n-grams."""
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.zeros(3, np.float32))
    texts = [b"", b"x", b"hello w\xc3\xb6rld", b"ab" * 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = model.logits(data, np.cumsum([0, *map(len, texts)]))
    for t, row in zip(texts, got):
        buckets = [int(langid.gram_buckets(np.frombuffer(t[i : i + n], np.uint8))[n - 1][0]) for n in langid.GRAMS for i in range(len(t) - n + 1)]
        assert np.allclose(row, model.table[buckets].mean(0) if buckets else 0, atol=1e-4)


LONG = """
import sys, resource
import numpy as np
sys.path.insert(0, sys.argv[1])
from tidemark.llm import langid, quality
rng = np.random.default_rng(1)
words = np.array(["".join(rng.choice(list("abcdefgh\u00e9"), rng.integers(1, 9))) for _ in range(5000)], object)
data = np.frombuffer(" ".join(rng.choice(words, 6_000_000)).encode()[: 32 << 20], np.uint8)
at, before = np.array([0, len(data)]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
languages = [str(k) for k in range(180)]
langid.Model(languages, rng.normal(size=(langid.BUCKETS, 180)).astype(np.float32), np.zeros(180, np.float32)).predict(data, at)
many = np.arange(0, 1 << 20, 100)
langid.Model(languages, rng.normal(size=(langid.BUCKETS, 180)).astype(np.float32), np.zeros(180, np.float32)).predict(data[: many[-1]], many)
assert np.isfinite(quality.features(data, at)).all()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_of_a_text_of_32_mb_and_180_languages():
    done = subprocess.run([sys.executable, "-c", LONG, str(Path(__file__).resolve().parents[2])], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < 500
