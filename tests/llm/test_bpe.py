import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = P.path("byte_bpe_50k.json")


def test_like_the_library(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "  ", "a  b", "don't 'S ''s\n\n x", "<|endoftext|> hi<|endoftext|>", "日本語テキスト 日本", "é  è\r\n\té", "🎉🎉a  b\u3000 c\u00a0\u00a0 d", "\x00 \x7f", "a" * 5000 + " " * 300 + "b"]
    texts += ["".join(rng.choice("ab'st \n\té 8,.\u00a0") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (1, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(df, PATH).collect()))
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    full = bpe.encode_documents(df.filter("doc_id = 5"), PATH).first()
    assert list(full.ids) == lib.encode(texts[5], add_special_tokens=False).ids and full.decoded == texts[5]
    assert bpe.digest_documents(df.limit(0), PATH).collect() == []


def thue_morse(n):
    """Two texts of n letters on which a polynomial modulo 2^64 agrees for n of 1024 and more."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_that_a_polynomial_confuses(spark):
    lib = Tokenizer.from_file(PATH)
    a, b = thue_morse(2048)
    texts = [a, b, f"x {a} y", f"x {b} y", f"{a}。{b}"]
    got = {r.doc_id: list(r.ids) for r in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), PATH).collect()}
    assert got == {i: lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_cuts_between_ideographs():
    rng, lib, codec = random.Random(8), Tokenizer.from_file(PATH), bpe.Codec(PATH)
    alphabet = "日本語漢字倀\u8fff\u9000\u4fffかな、。 's!éx1\n"
    cut = 0
    for _ in range(800):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
        data = np.frombuffer(t.encode(), np.uint8)
        cut += int(codec.cuts(data).sum())
        assert codec.encode(data, np.array([0, len(data)]))[0].tolist() == lib.encode(t, add_special_tokens=False).ids
    assert cut > 1000


def test_other_rules_have_no_cuts(tmp_path):
    import json

    spec = json.loads(Path(PATH).read_text())
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    codec = bpe.Codec(str(tmp_path / "v.json"))
    data = np.frombuffer(b"One TWO  three", np.uint8)
    assert not codec.cuts(data).any()
    assert codec.encode(data, np.array([0, len(data)]))[0].tolist() == Tokenizer.from_file(str(tmp_path / "v.json")).encode("One TWO  three").ids


LONG = """
import sys, resource
import numpy as np, pyarrow as pa
sys.path.insert(0, sys.argv[1])
from tidemark.llm import bpe
rng = np.random.default_rng(1)
words = np.array(["".join(rng.choice(list("abcdefgh\u00e9\u65e5"), rng.integers(1, 9))) for _ in range(5000)], object)
data = np.frombuffer(" ".join(rng.choice(words, 6_000_000)).encode()[: 32 << 20].decode("utf-8", "ignore").encode(), np.uint8)
codec, before, total, size = bpe.Codec.load(sys.argv[2]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0
for i, j, ids, at, last in codec.rows(data, np.array([0, len(data)])):
    assert codec.decode(ids).tobytes() == data[size : size + int(codec.token_len[ids].sum())].tobytes()
    size += int(codec.token_len[ids].sum())
assert size == len(data) and last
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_of_a_text_of_32_mb():
    done = subprocess.run([sys.executable, "-c", LONG, str(Path(__file__).resolve().parents[2]), PATH], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < 700


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 50)
    lib, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    for text in ("a b  c\n\nd " * 100, "x" * 500, "日本語漢字" * 60, "é" * 300 + " z"):
        data = np.frombuffer(text.encode(), np.uint8)
        parts = list(codec.rows(data, np.array([0, len(data)])))
        assert np.concatenate([p[2] for p in parts]).tolist() == lib.encode(text, add_special_tokens=False).ids and [p[4] for p in parts] == [False] * (len(parts) - 1) + [True]
