"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace) over the vocabulary resolves a pre-token that is a token
itself; the key stored at its place confirms the match. Tier two: a heap over linked bytes merges the misses.
The table is built once by the driver and broadcast; its size is that of the vocabulary file. Each worker keeps a
bounded memo of pre-tokens. Nothing is shuffled.

Defined results: a null or empty text gives no ids, the digest of nothing and an empty decoded text; the decoded
bytes always equal the text's UTF-8; whole texts of any length; rows that repeat are encoded each; other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .bpe import Memo, Splitter, heap_encode, read_ranks, split_pattern
from .common import by_bytes, per_worker, pick

#: Entries of a worker's memo, beyond which it is emptied: the executors of a pipeline hold much else by now.
MEMO_ENTRIES = 200_000
_MIX, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash from tokens to ranks: n tokens have the n places."""

    def __init__(self, ranks: dict[bytes, int], load: int = 4):
        keys = list(ranks)
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.place: list[int] = [-1] * self.n
        free = bytearray(b"\1" * self.n)
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            group = members[b]
            if len(group) == 1:
                singles.append(b)
            elif group:
                d = 1
                while True:
                    spots = [self._spot(hashes[i], d) for i in group]
                    if len(set(spots)) == len(spots) and all(free[s] for s in spots):
                        break
                    d += 1
                self.shift[b] = d
                for i, s in zip(group, spots, strict=True):
                    free[s], self.place[s] = 0, i
        rest = (s for s in range(self.n) if free[s])
        for b in singles:  # a lone key goes straight to a free place
            s = next(rest)
            self.shift[b], self.place[s] = -s - 1, members[b][0]
        self.keys = [keys[i] for i in self.place]
        self.ranks = [ranks[k] for k in self.keys]

    def _spot(self, h: int, d: int) -> int:
        return (((h ^ (d * _MIX & _WORD)) * 0xD6E8FEB86659FD93 & _WORD) >> 32) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._spot(h, d)
        return self.ranks[s] if self.keys[s] == key else None


@functools.lru_cache(1)
def perfect_hash(vocabulary: str) -> PerfectHash:
    return PerfectHash(read_ranks(public_tokenizers.path(vocabulary)))


class ByteCodec:
    def __init__(self, table: PerfectHash):
        self.table = table
        self.ranks = dict(zip(table.keys, table.ranks, strict=True))
        self.bytes_of = {r: k for k, r in self.ranks.items()}
        self.memo = Memo(self._piece, MEMO_ENTRIES)
        self.split = Splitter(split_pattern)

    def _piece(self, token: str) -> bytes:
        piece = token.encode()
        rank = self.table.get(piece)
        return struct.pack("<I", rank) if rank is not None else (lambda ids: struct.pack(f"<{len(ids)}I", *ids))(heap_encode(piece, self.ranks))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        self.memo.trim()
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_encode(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids (binary, unsigned 32-bit) and decoded (binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(perfect_hash(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or per_worker("codec", vocabulary, lambda: ByteCodec(shared.value))
            for part in by_bytes(batch, "text", 1 << 20):
                ids = [codec.encode(t.as_py() or "") for t in part.column("text")]
                back = [codec.decode(x) for x in ids]
                cols = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                more = [pa.array(ids, pa.binary()), pa.array(back, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols + more, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 4 + len(more)])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids)


def byte_decode(encoded: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for rows that hold ids as little-endian unsigned 32-bit integers; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(perfect_hash(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or per_worker("codec", vocabulary, lambda: ByteCodec(shared.value))
            texts = [codec.decode(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = pick(encoded, doc_id=id_col, ids=ids_col)
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
