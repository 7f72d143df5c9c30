"""Content-addressed store of token ids.

Encoding: each worker splits texts at ASCII blanks, which no pre-token reaches over, numbers the stretches between by a dictionary
of the texts at hand, looks the distinct ones up in a bounded memo, cuts those that it lacks into pre-tokens, asks the tokenizer library for
the ids of those that a second memo lacks, and appends the end id to each document; texts that the split could see otherwise than the library, and
vocabulary files of another build, go to the library whole. Chunking: a rolling hash over the last ids of a document
cuts its stream, with a least and a greatest length. Files below ``path``: ``chunks`` (each distinct chunk once:
SHA-256, ids as little-endian unsigned 32-bit integers), ``recipes`` (documents in ascending doc_id order: start,
length, the chunks' digests and ends, and the document's node of a Merkle tree: the hash of its chunks' digests and its length)
and ``manifest`` (the tree above: leaves over LEAF_DOCS documents in order, then 2**FAN_BITS nodes to a parent, level by level, up to
one root). Reading checks every chunk against its digest, every document against its root and every node
of the manifest against its children; a store that does not verify is an error.

Payloads of chunks that occur once go to the store without a shuffle; a filter picks the others,
which are dropped to one by digest after partial aggregation. Starts are prefix sums in two levels.

Defined results: a null or empty text is the end id alone; null ids come first in order; rows that repeat are
documents of their own; whole texts of any length; an empty table writes empty files; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, splitter
from .common import bit_filter, by_bytes, discard, materialize, per_worker, pick, probe, scratch_path, trim_worker

END_ID = 1
#: Chunk lengths in ids: least, greatest, and one cut in 2**CUT_BITS places on average.
LEAST, GREATEST, CUT_BITS, SPAN = 128, 4096, 9, 8
#: Documents in a piece of the recipes, up to MOST_PIECES pieces; documents to a leaf of the manifest; binary digits of a parent's children.
PIECE_DOCS, MOST_PIECES, LEAF_DOCS, FAN_BITS = 1 << 14, 20_000, 1 << 10, 6
#: A memo of stretches is emptied beyond this number of entries, that of words beyond WORDS times as many, both beyond so many ids, so a
#: worker's memory stays bounded; bytes of texts that are encoded at once.
MEMO_ENTRIES, WORDS, _ROOM, PART = 400_000, 1.6, 1 << 22, 1 << 22
#: Words that one call of the library encodes.
CALL = 256
#: The split that no blank is part of; stretches between blanks can be cut alone.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Table:
    """Words and the ids of each, by number."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.n, self.used = 0, 0
        self.starts, self.sizes, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, "<u4")

    def full(self, times: float = 1) -> bool:
        return len(self.places) > times * MEMO_ENTRIES or self.used > _ROOM

    def numbers(self, words: list[str]) -> np.ndarray:
        """-1 for a word that is not held."""
        return np.fromiter(map(self.places.get, words, itertools.repeat(-1)), np.int64, len(words))

    def keep(self, words: list[str]) -> None:
        """The words that are added next."""
        self.places.update(zip(words, range(self.n, self.n + len(words)), strict=True))

    def drop(self, n: int, used: int) -> None:
        """Back to the first n words, which have so many ids."""
        self.n, self.used = n, used

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        """The ids of the next words, end to end."""
        n = len(sizes)
        while self.n + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.starts[self.n : self.n + n], self.sizes[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + n, self.used + len(flat)

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these numbers, end to end, and where those of each end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class LibraryEncoder:
    """Ids of whole texts, as the tokenizers library gives them, with a memo of pre-tokens where the file's build allows it."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(spec)
        self.whole.no_padding()
        self.whole.no_truncation()
        data = json.loads(spec)
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.pattern = self._pattern(data)
        if self.pattern is None:
            return
        self.cut = splitter(list(self.special))
        # The same model for pre-tokens that are normalised, split and written in byte letters already.
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {**dict(enumerate(byte_letters())), 32: " "}
        # Every pre-token's last id, and no other, has the file's mark of a word's end: so many can be encoded in one call.
        suffix, vocab = data["model"]["end_of_word_suffix"], self.whole.get_vocab(False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.alike: set[str] = set(map(chr, range(128)))
        self.strange: set[str] = set()
        self.marked = regex.compile(self.pattern.pattern + "|\n")
        self._reset()

    def _reset(self) -> None:
        self.stretches, self.words = _Table(), _Table()
        self.words.places["\n"] = 0  # stands between stretches that are cut together, and has no ids
        self.words.add(np.zeros(1, np.int64), np.zeros(0, "<u4"))

    @staticmethod
    def _pattern(data: dict) -> regex.Pattern | None:
        """The file's split, if it normalises by NFC and lower case with blanks as blanks, cuts by one pattern, drops what is between and goes on with bytes."""
        steps = data.get("normalizer") or {}
        kinds = [(n.get("type"), n.get("content")) for n in steps.get("normalizers", [])]
        cuts = (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = all(not t[k] for t in data.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if data["model"]["type"] != "BPE" or not data["model"].get("end_of_word_suffix") or kinds != [("NFC", None), ("Replace", " "), ("Lowercase", None)] or steps["normalizers"][1]["pattern"] != {"Regex": r"\s+"} or not plain:
            return None
        if [c.get("type") for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
            return None
        return regex.compile(_SPLIT) if cuts[0]["pattern"] == {"Regex": _SPLIT} else None

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case character by character (so no final sigma); white space falls away when splitting."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _knows(self, text: str) -> bool:
        """Whether Python's and the library's Unicode tables say the same of every character."""
        if text.isascii() or self.alike.issuperset(text):
            return True
        for c in set(text) - self.alike - self.strange:
            same = unicodedata.category(c) not in ("Cn", "Cs") and self.whole.normalizer.normalize_str(c) == (" " if c.isspace() else self.normalise(c))
            words = self.pattern.findall(self.normalise(f"a{c}b{c}{c}"))
            cut = [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(f"a{c}b{c}{c}"))]
            (self.alike if same and len(cut) == len(words) else self.strange).add(c)
        return self.strange.isdisjoint(text)

    def _learn(self, words: list[str]) -> None:
        """Keeps fresh words and their ids."""
        for at in range(0, len(words), CALL):
            part = words[at : at + CALL]
            line = " ".join(part)
            if not line.isascii():
                line = line.encode().decode("latin-1").translate(self.letters)
            flat = np.array(self.pieces.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.last[flat]) + 1
            if len(stops) != len(part):
                raise ValueError("the vocabulary does not mark the end of every word")
            self.words.keep(part)
            self.words.add(np.diff(stops, prepend=0), flat)

    def _cut(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each stretch has, and the ids, end to end."""
        found = self.marked.findall(self.normalise("\n".join(stretches)))
        at = self.words.numbers(found)
        if len(fresh := np.flatnonzero(at < 0)):
            words = [found[i] for i in fresh.tolist()]
            self._learn(list(dict.fromkeys(words)))
            at[fresh] = self.words.numbers(words)
        ids, ends = self.words.ids_of(at)
        return np.diff(np.concatenate([[0], ends[at == 0], [len(ids)]])), ids

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special strings that hold known characters only."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string() if sum(map(len, texts)) < 1 << 29 else pa.large_string()))
        coded = split.values.dictionary_encode()
        words, indices = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        at, table = self.stretches.numbers(words), self.stretches
        if len(fresh := np.flatnonzero(at < 0)):
            # Stretches that occur here more than once are kept; the others are mostly rare, and go with these texts.
            often = np.bincount(indices, minlength=len(words))[fresh] > 1
            kept = int(often.sum())
            fresh = np.concatenate([fresh[often], fresh[~often]])
            cut = [words[i] for i in fresh.tolist()]
            sizes, flat = self._cut(cut)
            at[fresh] = np.arange(table.n, table.n + len(cut))
            table.keep(cut[:kept])
            table.add(sizes, flat)
            ids, ends = table.ids_of(at[indices])
            table.drop(table.n - len(cut) + kept, table.used - int(sizes[kept:].sum()))
        else:
            ids, ends = table.ids_of(at[indices])
        edges = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.pattern is None:
            return [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        if self.words.full(WORDS):
            self._reset()
        elif self.stretches.full():
            self.stretches = _Table()
        parts = [self.cut(t) if self._knows(t) else None for t in texts]
        runs = iter(self._run([p for doc in parts if doc is not None for p in doc[::2]]))
        out = []
        for text, doc in zip(texts, parts, strict=True):
            if doc is None:
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4"))
            else:
                found = [next(runs) if k % 2 == 0 else np.array([self.special[p]], "<u4") for k, p in enumerate(doc)]
                out.append(found[0] if len(found) == 1 else np.concatenate(found))
        return out


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a rolling hash over the last SPAN ids says cut; of one stream or of many end to end."""
    n = len(ids)
    if n < SPAN:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        rolled, k = mixed, 1
        while k < SPAN:  # over 2 k ids: those of the last k, and those of the k before moved up
            rolled, k = rolled[k:] + (rolled[:-k] << np.uint64(k)), 2 * k
    return np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + SPAN


def cuts(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids with marks at the given places; a chunk has LEAST ids at least, so a mark
    that counts hangs on the document's own ids alone, and equal passages cut alike."""
    out, last = [], 0
    for mark in at:
        while mark - last > GREATEST:
            last += GREATEST
            out.append(last)
        if mark - last >= LEAST:
            out.append(mark)
            last = mark
    while n - last > GREATEST:
        last += GREATEST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def _stage(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, chunks: array of (digest, end, ids or null if this task has given them already)."""
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a fixed 2 MB
    end = np.uint32(end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, given = None, set()
        for batch in batches:
            encoder = encoder or per_worker("encoder", vocabulary, lambda: LibraryEncoder(shared.value))
            for part in by_bytes(batch, "text", PART):
                counts, offsets, digests, ends, payloads = [], [0], [], [], []
                streams = [np.append(ids, end) for ids in encoder.encode([t or "" for t in part.column("text").to_pylist()])]
                flat = np.concatenate(streams)
                raw, edges = flat.tobytes(), np.cumsum([0, *map(len, streams)])
                found = marks(flat)
                spots = np.searchsorted(found, edges, side="right").tolist()
                for i, first in enumerate(edges[:-1].tolist()):
                    counts.append(len(streams[i]))
                    last = first
                    for stop in cuts(counts[-1], (found[spots[i] : spots[i + 1]] - first).tolist()):
                        payload = raw[4 * last : 4 * (first + stop)]
                        digest = hashlib.sha256(payload).digest()
                        digests.append(digest)
                        ends.append(stop)
                        payloads.append(None if digest in given else payload)
                        given.add(digest)
                        last = first + stop
                    offsets.append(len(ends))
                if len(given) > MEMO_ENTRIES:
                    given.clear()
                inner = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(ends, pa.int64()), pa.array(payloads, pa.binary())], ["digest", "end", "ids"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], ["doc_id", "n_tokens", "chunks"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim_worker()  # the worker idles while the store is written

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(task, f"doc_id {kind}, n_tokens long, chunks array<struct<digest: binary, end: long, ids: binary>>")


def write_store(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    spark = docs.sparkSession
    staged = materialize(spark, _stage(pick(docs, doc_id=id_col, text=text_col), vocabulary, end_id), "store-staged", compression="zstd")

    # Unique chunks. Digests given once by all tasks together pass as they are; only the others meet.
    given = staged.select(F.explode("chunks").alias("c")).select("c.digest", "c.ids").filter("ids is not null")
    again = staged.select(F.explode(F.expr("transform(filter(chunks, c -> c.ids is not null), c -> c.digest)")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    given = probe(given, bit_filter(again, "digest"), "digest")
    unique = given.filter("not hit").select("digest", "ids").unionByName(given.filter("hit").groupBy("digest").agg(F.first("ids").alias("ids")))
    unique.write.option("compression", "zstd").parquet(f"{path}/chunks")

    # Recipes in ascending order, in pieces; each piece's first start is the sum of the pieces before.
    slim = staged.select("doc_id", "n_tokens", F.expr("transform(chunks, c -> c.digest)").alias("digests"), F.expr("transform(chunks, c -> c.end)").alias("ends"))
    pieces = min(MOST_PIECES, max(1, -(-slim.count() // PIECE_DOCS)))
    ranged = slim.withColumn("tie", F.element_at("digests", 1)).repartitionByRange(pieces, F.col("doc_id"), F.col("n_tokens"), F.col("tie")).withColumn("piece", F.spark_partition_id())
    ranged = materialize(spark, ranged, "store-ranged")
    sums = ranged.groupBy("piece").agg(F.sum("n_tokens").alias("words"), F.count(F.lit(1)).alias("docs"))
    most = sums.agg(F.max("docs")).first()[0] or 1
    bits = (((most - 1) // LEAF_DOCS).bit_length() + FAN_BITS - 1) // FAN_BITS * FAN_BITS  # of a leaf's number in its piece
    first = F.coalesce(F.sum("words").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("piece", first.alias("first"))
    order = Window.partitionBy("piece").orderBy("doc_id", "n_tokens", "tie")
    recipes = ranged.withColumn("inside", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).withColumn("nth", F.row_number().over(order) - 1).join(sums, "piece")
    leaf = F.shiftleft(F.col("piece").cast("long"), bits) + F.expr(f"nth div {LEAF_DOCS}")
    recipes = recipes.select(leaf.alias("leaf"), "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "digests", "ends", document_node("digests", "n_tokens").alias("root"))
    recipes.sortWithinPartitions("leaf", "start").write.parquet(f"{path}/recipes")
    # The manifest: level by level, until one node is left.
    level, height = _leaves(spark.read.parquet(f"{path}/recipes")), 0
    while True:
        level = materialize(spark, level, "store-level")
        level.withColumn("level", F.lit(height)).write.mode("append").parquet(f"{path}/manifest")
        if level.count() <= 1:
            break
        level, height = _parents(level), height + 1
    discard(spark, staged, ranged)


def _node(children):
    """A node of the tree: SHA-256 over its children's hashes in order, as hexadecimal digits."""
    return F.sha2(F.array_join(children, ""), 256)


def document_node(digests: str, n_tokens: str):
    return F.sha2(F.concat(F.array_join(F.transform(digests, F.hex), ""), F.lit(":"), F.col(n_tokens).cast("string")), 256)


def _leaves(recipes: DataFrame) -> DataFrame:
    """(node, start, n_tokens, n_docs, root): the nodes over the documents of a leaf."""
    found = recipes.groupBy(F.col("leaf").alias("node")).agg(F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.sort_array(F.collect_list(F.struct("start", "root"))).alias("roots"))
    return found.select("node", "start", "n_tokens", "n_docs", _node(F.col("roots")["root"]).alias("root"))


def _parents(level: DataFrame) -> DataFrame:
    found = level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"), F.sort_array(F.collect_list(F.struct(F.col("node").alias("at"), "root"))).alias("roots"))
    return found.select("node", "start", "n_tokens", "n_docs", _node(F.col("roots")["root"]).alias("root"))


_CRC = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC-32 polynomial, bits reflected."""
    out = np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(_CRC), b >> np.uint32(1))
    return out


@functools.cache
def _moves(k: int) -> np.ndarray:
    """What each value of each of the four bytes of a CRC adds when 2**k bytes follow."""
    square = np.full(1, 0x00800000, np.uint32)  # x**8
    for _ in range(k):
        square = _times(square, square.copy())
    values = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    return _times(values, np.broadcast_to(square, values.shape).copy())


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a chunk's CRC adds to that of a stream in which ``n_bytes`` follow it."""
    out, left, k = crc.astype(np.uint32), n_bytes.astype(np.int64).copy(), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            some, moves = out[odd], _moves(k)
            out[odd] = moves[0][some & 255] ^ moves[1][some >> 8 & 255] ^ moves[2][some >> 16 & 255] ^ moves[3][some >> 24]
        left >>= 1
        k += 1
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32, verified (all chunks match their digests, the root matches them)."""
    chunks = spark.read.parquet(f"{path}/chunks")
    facts = chunks.select("digest", F.crc32("ids").alias("crc"), (F.sha2("ids", 256) == F.lower(F.hex("digest"))).alias("intact"))
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("doc_id", "start", "n_tokens", (F.col("root") == document_node("digests", "n_tokens")).alias("rooted"), F.explode(F.arrays_zip("digests", "ends")).alias("c"))
    uses = uses.select("doc_id", "start", "n_tokens", "rooted", F.col("c.digests").alias("digest"), (4 * (F.col("n_tokens") - F.col("c.ends"))).alias("after"))
    joined = uses.join(facts, "digest", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = b.column("crc").fill_null(0).to_numpy(zero_copy_only=False)
            part = shift_crc(crc, b.column("after").to_numpy(zero_copy_only=False)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(part), b.column("good")], ["doc_id", "start", "n_tokens", "part", "good"])

    kind = dict(recipes.dtypes)["doc_id"]
    parts = joined.select("doc_id", "start", "n_tokens", "crc", "after", (F.col("rooted") & F.coalesce("intact", F.lit(False))).alias("good"))
    parts = parts.mapInArrow(work, f"doc_id {kind}, start long, n_tokens long, part long, good boolean")
    out = parts.groupBy("start", "doc_id", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"), F.min("good").alias("verified"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Whole id streams rebuilt from chunks: doc_id, start, ids (binary). Moves all payloads; for export."""
    chunks = spark.read.parquet(f"{path}/chunks")
    uses = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    rows = uses.join(chunks, "digest").groupBy("start", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    return rows.select("doc_id", "start", F.unhex(F.array_join(F.transform(F.col("parts")["ids"], F.hex), "")).alias("ids"))


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the manifest that their children (for leaves: the recipes) do not give; empty if recipes and manifest are whole."""
    manifest = spark.read.parquet(f"{path}/manifest")
    now = _leaves(spark.read.parquet(f"{path}/recipes")).withColumn("level", F.lit(0))
    top = manifest.agg(F.max("level")).first()[0] or 0
    for height in range(top):
        now = now.unionByName(_parents(manifest.filter(F.col("level") == height)).withColumn("level", F.lit(height + 1)))
    facts = lambda df, p: df.select("level", "node", F.struct("start", "n_tokens", "n_docs", "root").alias(p))
    both = facts(manifest, "written").join(facts(now, "found"), ["level", "node"], "full")
    return both.filter(~F.col("written").eqNullSafe(F.col("found")))


def stored_tokens(docs: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Write the store (below the shared folder unless ``path`` is given), check its manifest and read it back.

    A manifest that does not fit the recipes is an error here; a document whose chunks or root are not whole is an error when it is read.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-store")
    write_store(docs, path, **options)
    if broken := verify_manifest(spark, path).take(1):
        raise ValueError(f"the token store's manifest does not fit its recipes: {broken[0]}")
    whole = F.when(F.col("verified"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document of the token store does not verify")).cast("long"))
    return read_store(spark, path).withColumn("ids_crc32", whole)
