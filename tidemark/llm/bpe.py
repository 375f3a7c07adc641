"""Operator 10: byte-pair encoding and decoding by forced-boundary splitting.

A pair of bytes that no token of the vocabulary holds side by side can never be
merged, so a cut between them is certain where the pre-tokenizer does not care
either.  Text is cut at such pairs

* whose second byte is ASCII white space and whose first is not: there the
  pre-tokenizer always starts anew, whatever stands on either side;
* between two characters of U+5000 to U+8FFF: both are letters, so the
  pre-tokenizer's word goes on over the cut, and merges do not.

Equal fragments (of at most FRAGMENT_BYTES) are encoded once per task, found by
their bytes; the ids of a text are the concatenation of the ids of its fragments.
A vocabulary with another pre-tokenizer, a normalizer or added tokens that take in
their surroundings has no certain cuts: its texts are encoded whole.

Edge cases: a null or empty text gives no ids and decodes to the empty text;
every input row gives one output row, repeated rows and null ids included; a
text beyond SLICE_BYTES is worked on in pieces between certain cuts; a stretch
without a certain cut is one fragment, whatever its length, and takes the memory
that the library needs for it.  The vocabulary's own control strings in a text
become their ids, as in the ``tokenizers`` library.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import SLICE_BYTES, SPACE, column_bytes, lean, ranges, slices

#: Ids kept by a worker for fragments that it has met (4 bytes each); then it starts afresh.
CACHE_IDS = 1_000_000
#: Longer fragments are not remembered.
FRAGMENT_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file, for one process."""

    _made: dict[str, Codec] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.inside = np.zeros((256, 256), bool)
        for t in tokens.values():
            pair = np.frombuffer(t, np.uint8)
            self.inside[pair[:-1], pair[1:]] = True
        for x in spec["added_tokens"]:
            tokens[x["id"]] = x["content"].encode()
            raw = np.frombuffer(tokens[x["id"]], np.uint8)
            self.inside[raw[:-1], raw[1:]] = True
        self.known_rules = _plain_rules(spec)
        self.cut = ~self.inside & SPACE[None, :] & ~SPACE[:, None] & self.known_rules
        size = max(tokens) + 1
        lengths = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.token_len, self.token_at = lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # fragment -> its number
        self.at, self.len = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.store = np.zeros(1 << 16, np.uint32)
        self.count = self.used = 0

    def close(self) -> None:
        """Gives back what was learned; Spark keeps the process for other tasks, which need the memory."""
        self._forget()
        pa.default_memory_pool().release_unused()

    def _learn(self, texts: list[bytes]) -> None:
        """Encodes fragments and numbers them from ``count`` on."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))
        self.store, self.at, self.len = (_room(a, n) for a, n in ((self.store, self.used + len(flat)), (self.at, self.count + len(found)), (self.len, self.count + len(found))))
        self.store[self.used : self.used + len(flat)] = flat
        self.at[self.count : self.count + len(found)] = self.used + np.cumsum(lengths) - lengths
        self.len[self.count : self.count + len(found)] = lengths
        self.used += len(flat)
        self.count += len(found)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a cut before each byte is certain."""
        head = np.zeros(len(data), bool)
        head[1:] = self.cut[data[:-1], data[1:]]
        if self.known_rules and len(data) > 3:
            letter = (data >= 0xE5) & (data <= 0xE8)  # first bytes of U+5000 to U+8FFF
            head[3:] |= letter[3:] & letter[:-3] & ~self.inside[data[2:-1], data[3:]]
        return head

    def pieces(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of one text between certain cuts, of about SLICE_BYTES; one without a cut is longer."""
        lo, n = 0, len(data)
        while lo < n:
            hi = min(n, lo + SLICE_BYTES)
            while hi < n:
                base = max(lo, hi - SLICE_BYTES - 3)
                found = np.flatnonzero(self.cuts(data[base : hi + 1])) + base
                found = found[found > lo]
                if len(found):
                    hi = int(found[-1])
                    break
                hi = min(n, hi + SLICE_BYTES)
            yield lo, hi
            lo = hi

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        head = self.cuts(data)
        head[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(head)
        raw = data.tobytes()
        fragments = [raw[s:e] for s, e in zip(starts.tolist(), starts[1:].tolist() + [n])]
        if self.used > CACHE_IDS:
            self._forget()
        number = list(map(self.known.get, fragments))
        if None in number:
            new: dict[bytes, int] = {}
            for k, x in enumerate(number):
                if x is None:
                    number[k] = new.setdefault(fragments[k], self.count + len(new))
            self._learn(list(new))
            self.known.update(x for x in new.items() if len(x[0]) <= FRAGMENT_BYTES)
        which = np.array(number, np.int64)
        lengths = self.len[which]
        ids = self.store[ranges(self.at[which], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, offsets)]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), a slice or a piece at a time, so that only ids add up."""
        parts, lengths = [np.zeros(0, np.uint32)], np.zeros(len(offsets) - 1, np.int64)
        for i, j, ids, at, _ in self.rows(data, offsets):
            parts.append(ids)
            lengths[i:j] += np.diff(at)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that a list of ids stands for."""
        return self.token_bytes[ranges(self.token_at[ids], self.token_len[ids])]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
        """(first row, row behind the last, ids, where each row's begin, whether the rows end here); a long row comes in several parts."""
        for i, j in slices(offsets):
            mine = data[offsets[i] : offsets[j]]
            if j - i > 1 or len(mine) <= SLICE_BYTES:
                yield i, j, *self.encode(mine, offsets[i : j + 1] - offsets[i]), True
                continue
            for lo, hi in self.pieces(mine):
                yield i, j, *self.encode(mine[lo:hi], np.array([0, hi - lo])), hi == len(mine)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def _plain_rules(spec: dict) -> bool:
    """Whether the cuts are certain: byte-level words by the usual pattern, nothing normalized, added tokens that stand for themselves."""
    pre = spec.get("pre_tokenizer") or {}
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    model = spec["model"]
    alone = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec["added_tokens"])
    affixes = model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout")
    return bool(usual and alone and not affixes and not spec.get("normalizer") and not spec.get("post_processor"))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held = Codec.load(vocabulary), []
        for batch in batches:
            for i, j, ids, at, last in codec.rows(*column_bytes(batch.column(1))):
                held.append(ids)
                if not last:
                    continue
                if len(held) > 1:
                    ids = np.concatenate(held)
                    at = np.array([0, len(ids)])
                held = []
                out = [codec.decode(ids[a:b]).tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(out, pa.string())], names=["doc_id", "ids", "decoded"])
        codec.close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


class _Digest:
    """Of one long text whose parts come one after another."""

    def __init__(self):
        self.count, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: np.ndarray, raw: bytes, last: bool) -> tuple:
        self.count += len(ids)
        self.ids.update(ids.tobytes())
        self.text.update(self.decoder.decode(raw, last).encode())
        return self.count, self.ids.hexdigest(), self.text.hexdigest()


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode_documents gives, as digests made beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, long_ = Codec.load(vocabulary), None
        for batch in batches:
            for i, j, ids, at, last in codec.rows(*column_bytes(batch.column(1))):
                ids = ids.astype("<u4")
                back = codec.decode(ids)
                if not last or long_:
                    long_ = long_ or _Digest()
                    out = [long_.add(ids, back.tobytes(), last)]
                    if not last:
                        continue
                    long_ = None
                else:
                    ends = np.concatenate([[0], np.cumsum(codec.token_len[ids])])[at]
                    out = [_Digest().add(ids[at[k] : at[k + 1]], back[ends[k] : ends[k + 1]].tobytes(), True) for k in range(j - i)]
                count, digests, texts = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
