"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up inside one
token, so no merge crosses it. Every such pair is a cut: a word is cut there, each fragment is
merged on its own, and the ids are concatenated. Only the last fragment of a word carries the
word-end mark. Fragments and words recur, so both are kept in bounded caches.

The rules of the vocabulary file that are followed: NFC, white space separates and is dropped,
lower case code point by code point, words split by the file's pattern, byte-level alphabet,
special tokens found in the raw text before anything else, and, as the file names no decoder,
decoding joins the token strings by one space.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import texts, tune

#: Entries of the cache of chunks and words, in each worker, and the longest that are kept.
KNOWN, KEPT = 500_000, 128
#: Bytes from which a fragment's pairs are kept in a heap instead of being searched.
LONG = 100
#: Beyond every rank.
FAR = 1 << 60
#: White space of the vocabulary's pattern (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT, _ODD, _OTHER = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]"), re.compile("[^\x00-\u024f]")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Cache(dict):
    """A dict that makes missing values and stops growing at a size."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and len(key) <= KEPT:
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.byte = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left id, right id) as one integer, to rank and merged id as one integer.
        self.merges = {vocab[a] << 24 | vocab[b]: n << 24 | vocab[a + b] for n, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for text, n in [*vocab.items(), *self.special.items()]:
            self.token[n] = text
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.number = {c: b for b, c in enumerate(alphabet)}
        self.joined = self.inner_pairs(vocab, end)
        self.path, self.library = path, None
        self.known = _Cache(self._chunk, KNOWN)

    def inner_pairs(self, vocab: dict[str, int], end: str) -> set[tuple[int, int]]:
        """The pairs of neighbouring bytes that occur inside some token."""
        found: set[tuple[int, int]] = set()
        for t in vocab:
            body = [self.number[c] for c in (t.removesuffix(end) if end else t)]
            found.update(zip(body, body[1:]))
        return found

    def cut(self, word: bytes) -> list[bytes]:
        """The fragments of a word between its forced boundaries."""
        out, start = [], 0
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in self.joined:
                out.append(word[start:i])
                start = i
        return [*out, word[start:]]

    def _merge(self, fragment: bytes, last: bool) -> list[int]:
        """Ids of one fragment: the neighbouring pair of lowest rank is merged, leftmost first, until none is left."""
        ids = list(map(self.byte.__getitem__, fragment))
        if last:
            ids[-1] = self.last[fragment[-1]]
        if len(ids) >= LONG:
            return self._merge_long(ids)
        best = self.merges.get
        ranks = [best(a << 24 | b, FAR) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == FAR:
                break
            i = ranks.index(low)
            ids[i] = low & 0xFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = best(ids[i - 1] << 24 | ids[i], FAR)
            if i < len(ranks):
                ranks[i] = best(ids[i] << 24 | ids[i + 1], FAR)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in n log n: a heap of (rank, place), the places linked. An entry holds as long as the pair at
        its place still has that rank; one that does not was pushed for a pair that is gone."""
        best, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, r in enumerate(best(a << 24 | b, FAR) >> 24 for a, b in zip(ids, ids[1:])) if r < FAR >> 24]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = best(ids[i] << 24 | ids[j], FAR)
            if found >> 24 != entry >> 32:
                continue
            ids[i], ids[j] = found & 0xFFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = best(ids[i] << 24 | ids[k], FAR) >> 24
                if r < FAR >> 24:
                    heapq.heappush(heap, r << 32 | i)
            k = before[i]
            if k >= 0:
                r = best(ids[k] << 24 | ids[i], FAR) >> 24
                if r < FAR >> 24:
                    heapq.heappush(heap, r << 32 | k)
        return [x for x in ids if x >= 0]

    def _word(self, word: bytes) -> bytes:
        if self.joined.issuperset(zip(word, word[1:])):
            return pack(self._merge(word, True))
        cuts = self.cut(word)
        return pack([n for x in cuts[:-1] for n in self._merge(x, False)] + self._merge(cuts[-1], True))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space."""
        if _OTHER.search(chunk):
            return b"".join(map(self._word, self._other(chunk)))
        text = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower()
        words = self.words_of(text)
        if len(words) == 1:
            return self._word(words[0].encode("utf-8")) if words[0] == chunk else self.known[words[0]]
        return b"".join(map(self.known.__getitem__, words))

    def _other(self, chunk: str) -> list[bytes]:
        """Words of a chunk beyond the Latin blocks: letters and digits are as in the library's own Unicode tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(chunk)
        return [bytes(map(self.number.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str) -> bytes:
        chunks = filter(None, _SPLIT.split(text)) if _ODD.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or "<" not in text:
            return self._plain(text)
        parts = self.specials.split(text)
        return b"".join(self._plain(x) if n % 2 == 0 else pack([self.special[x]]) for n, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The file's codec, built once in each worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row per row of df: key, n_tokens, ids_sha256, decoded_sha256 and, with ids=True, ids (array<int>) and decoded.

    Null and empty texts have no tokens; repeated rows and keys each give a row; other columns are not read, so
    their names cannot clash. path is a vocabulary file that every executor can open.
    """
    tune(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = "key " + rows.schema["key"].dataType.simpleString() + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, one, two, lists, back = [], [], [], [], []
            for t in texts(b):
                raw = c.encode(t)
                plain = c.decode(raw)
                n.append(len(raw) // 4)
                one.append(hashlib.sha256(raw).hexdigest())
                two.append(hashlib.sha256(plain.encode("utf-8")).hexdigest())
                if ids:
                    lists.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    back.append(plain)
            out = {"key": b.column("key"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string())}
            if ids:
                out |= {"ids": pa.array(lists, pa.list_(pa.int32())), "decoded": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text: the token strings of an array of ids, joined as the file's (absent) decoder does. Null: empty."""
    tune(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = [c.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in b.column("ids")]
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "text": pa.array(out, pa.string())})

    return rows.mapInArrow(run, "key " + rows.schema["key"].dataType.simpleString() + ", text string").withColumnRenamed("key", key)
