"""Token counts by heap-and-linked-list byte-pair merging: initial symbols less merges; no ids are made.

Each worker keeps a bounded memo from pre-token to count. Scan, count, emit: nothing is shuffled, and a lost task
is run again on its own. Defined results: a null or empty text has 0 bytes and 0 tokens; a special string
inside a text counts as one token, as the library's default has it; any length of text or pre-token is
processed whole; rows that repeat are counted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, PairRanks, Splitter, split_pattern, splitter
from .common import per_worker, pick

LIMIT = 512


def counter(spec: str):
    """A function from a text to (symbols, merges)."""
    ranks = PairRanks(spec)
    cut = splitter(ranks.special)
    merges = Memo(lambda token: ranks.merges(token.encode()))
    find, get = Splitter(split_pattern), merges.__getitem__

    def count(text: str) -> tuple[int, int]:
        symbols = merged = 0
        for k, part in enumerate(cut(text)):
            if k % 2:
                symbols += 1
                continue
            symbols += len(part) if part.isascii() else len(part.encode())
            merged += sum(map(get, find(part)))
        merges.trim()
        return symbols, merged

    return count


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_symbols, n_merges, n_tokens, over_limit."""
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a fixed 2 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or per_worker("counts", vocabulary, lambda: counter(shared.value))
            text = pc.fill_null(batch.column("text"), "")
            found = [count(t.as_py()) for t in text]
            symbols, merged = pa.array([s for s, _ in found], pa.int64()), pa.array([m for _, m in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), symbols, merged], ["doc_id", "n_bytes", "n_symbols", "n_merges"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_symbols long, n_merges long")
    return out.withColumn("n_tokens", F.col("n_symbols") - F.col("n_merges")).withColumn("over_limit", F.col("n_tokens") > limit)
