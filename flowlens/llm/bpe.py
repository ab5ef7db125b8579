"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

Method.  A pre-token is a byte string.  ``bounds`` holds the part boundaries and ``ranks``
the merge rank of every adjacent pair, both in plain contiguous lists.  The loop scans
``ranks`` for its minimum (leftmost on ties), deletes that boundary and refreshes the two
neighbouring ranks, until no pair can merge.  Scanning is the fastest way for the short
words that make up nearly all text; pre-tokens above ``SCAN_BYTES`` keep their boundaries
in a linked list with a heap of (rank, position), which gives the same merges in
O(n log n).  Words are encoded once per worker (bounded cache).

Results.  The same ids as the public ``tokenizers`` library with
``add_special_tokens=False``: an added token's string found in the text becomes its own
id.  Null text counts as empty and gives no ids.  Rows are independent: repeated rows,
ties and extra columns need no care, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from flowlens.llm.common import doc_text, kept, map_arrow, utf8

SCAN_BYTES = 200
CACHE_WORDS = 500_000

# Fixed value: the byte-level pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the characters with the Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Cuts a text where PATTERN always cuts it: a run of other characters with the blank before
# it is split without a look at its neighbours, so whole chunks can be cached.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
NO_RANK = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others
    take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeCodec:
    """Encoder and decoder over the vocabulary and merges of one tokenizer file."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        chars = byte_alphabet()
        raw = lambda s: bytes(chars[c] for c in s)
        model = t["model"]
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.byte_ids = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self.ranks = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.added = {a["content"]: a["id"] for a in t.get("added_tokens", [])}
        self.words = regex.compile(PATTERN)
        self.specials = (regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)))
                         if self.added else None)
        self.table: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()], default=-1) + 1)
        for token, i in vocab.items():
            if all(c in chars for c in token):
                self.table[i] = raw(token)
        for s, i in self.added.items():
            self.table[i] = s.encode()
        # Ids of pre-tokens and of chunks of several (a pre-token by itself is its only one).
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token's parts."""
        return self._by_scan(word) if len(word) <= SCAN_BYTES else self._by_heap(word)

    def _by_scan(self, word: bytes) -> list[int]:
        """``parts[i]`` is the part between boundaries i and i + 1, ``ranks[i]`` the rank of
        its pair with the next one; merging deletes the boundary between them."""
        get, made = self.ranks.get, self.made
        parts = [self.byte_ids[b] for b in word]
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            part = parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | part, NO_RANK)
            if i < len(ranks):
                ranks[i] = get(part << 32 | parts[i + 1], NO_RANK)
        return parts

    def _by_heap(self, word: bytes) -> list[int]:
        n, get = len(word), self.ranks.get
        part = [self.byte_ids[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1)
                if (r := get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # one of the two parts has changed since
            part[i], part[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(part[i] << 32 | part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (p := before[i]) >= 0 and (r := get(part[p] << 32 | part[i])) is not None:
                heapq.heappush(heap, (r, p, part[p], part[i]))
        return [x for x in part if x >= 0]

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        if len(text) <= SCAN_BYTES:
            self.known[text] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        out = self.known.get(word)
        if out is None:
            out = array("I", self.merge(word.encode())).tobytes()
            if sys.byteorder == "big":
                out = np.frombuffer(out, ">u4").astype("<u4").tobytes()
            self._keep(word, out)
        return out

    def _chunk(self, chunk: str) -> bytes:
        words = self.words.findall(chunk)
        return self._word(chunk) if len(words) == 1 else self._keep(chunk, b"".join(map(self._word, words)))

    def _plain(self, text: str, out: list[bytes]) -> None:
        get, make = self.known.get, self._chunk
        out.extend([get(c) or make(c) for c in CHUNK.findall(text)])

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if self.specials is None:
            self._plain(text, out)
        else:
            at = 0
            for m in self.specials.finditer(text):
                self._plain(text[at:m.start()], out)
                out.append(np.array([self.added[m[0]]], "<u4").tobytes())
                at = m.end()
            self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def decode_ids(self, ids: list[int]) -> str:
        """The text of a sequence of ids (bytes that are not UTF-8: replacement characters)."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")

    def encode_batch(self, texts: pa.Array) -> pa.ListArray:
        rows = [self.encode_bytes(t) if t else b"" for t in texts.to_pylist()]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        values = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        return pa.array([self.decode_ids(x) if x else "" for x in ids.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def codec(spec: str) -> BpeCodec:
    """The worker's codec; its words stay until another operator takes the worker."""
    kept(__name__, codec.cache_clear)
    return BpeCodec(spec)


def read_spec(path: str) -> str:
    """The tokenizer file's text, read once on the driver (its size is fixed)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def coder(spark: SparkSession, path: str, source: str, ids: str, decoded: str | None,
          keep: list[str]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A batch function: ``keep`` columns, the ids of ``source`` and, if named, the text
    decoded from them.  The vocabulary (a file of fixed size) is broadcast."""
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(spec.value)
        found = c.encode_batch(batch.column(source))
        more = [c.decode_batch(found)] if decoded else []
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], found, *more],
                                          [*keep, ids, *([decoded] if decoded else [])])

    return run


def with_ids(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str | None = None,
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of ``docs`` and the ids of ``column`` as array<int>.

    ``decoded`` names a further column with the text decoded from those ids.  Input columns
    that clash with the new names are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded)]
    source = "__bpe_text"
    df = docs.select(*names, docs[column].cast("string").alias(source))
    schema = df.select(*names).schema.add(ids, ArrayType(IntegerType()))
    if decoded:
        schema = schema.add(decoded, "string")
    return map_arrow(df, coder(docs.sparkSession, path, source, ids, decoded, names), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with ``ids`` decoded into ``text`` (null ids: empty text)."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    names = [c for c in df.columns if c != text]
    schema = df.select(*names).schema.add(text, "string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = codec(spec.value).decode_batch(batch.column(ids))
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], out], [*names, text])

    return map_arrow(df.select(*names), run, schema)


def digest_batch(batch: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    """``keep`` and the digests of the columns ids and decoded."""
    ids = batch.column("ids")
    offsets = np.asarray(ids.offsets)
    flat = np.asarray(ids.values).astype("<u4").tobytes()
    ids_sha = [hashlib.sha256(flat[4 * a:4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
    text_sha = [hashlib.sha256(t).hexdigest() for t in utf8(batch.column("decoded"))]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in keep], pa.array(np.diff(offsets).astype(np.int64)), pa.array(ids_sha),
         pa.array(text_sha)], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])


def query(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Encoding, decoding and digests run on the same batch, so texts cross to Python once.
    """
    coded = coder(docs.sparkSession, path, "text", "ids", "decoded", ["doc_id"])
    return map_arrow(doc_text(docs), lambda batch: digest_batch(coded(batch), ["doc_id"]),
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, ids and the columns of ``query``: what a trainer reads."""
    coded = coder(docs.sparkSession, path, "text", "ids", "decoded", ["doc_id", "source"])
    return map_arrow(doc_text(docs, F.col("source").cast("string").alias("source")),
                     lambda batch: digest_batch(coded(batch), ["doc_id", "source", "ids"]),
                     "doc_id long, source string, ids array<int>, n_tokens long, ids_sha256 string, "
                     "decoded_sha256 string")
