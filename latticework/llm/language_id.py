"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary: all its entries that are letters only, in lower case, and every single
letter. Each language has a probability for each piece, fitted by expectation-maximisation over all segmentations of the
words of a bounded sample: SAMPLE_DOCS documents a language, by hash of the id, and of their words up to FIT_LETTERS letters
the SAMPLE_WORDS most frequent of each language. A word's probability in a language sums all its segmentations (forward
algorithm, rescaled as it goes, so words of any length keep their sums); a document's score multiplies its words' and the
languages share one posterior.

Scoring is a scan without shuffle; each worker keeps a bounded memo of words. The model has a column for each language of the
labels, a set that does not grow with the rows. Defined results: a null text, or one without letters, is ``und`` with score 0;
with no language to learn every text is ``und``; ties go to the first language by code point; rows that repeat are scored
each; other columns are never inputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import MEMO_LENGTH
from .common import by_bytes, per_worker, pick, share

#: Bounds of what the model is fitted on; scoring has none.
SAMPLE_DOCS, SAMPLE_WORDS, FIT_LETTERS = 600, 40_000, 48
#: Words of a worker's memo, beyond which it is emptied.
MEMO_WORDS = 300_000
#: Bytes of texts that are split into words at once.
PART = 1 << 20
#: Letters of words that are summed side by side.
BATCH_LETTERS = 1 << 16
ROUNDS, SMOOTH = 3, 0.05
UNKNOWN = 1e-7  # a single letter that no language has learned
_LETTERS = regex.compile(r"\p{L}+")


def vocabulary_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """The vocabulary's entries of letters only, without the word mark, in lower case, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = (model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size()))
    return list(dict.fromkeys(p for p in pieces if _LETTERS.fullmatch(p)))


class Pieces:
    """Finds the piece number of all substrings of many words at once; ``unknown`` marks single letters outside, ``none`` longer ones."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        with np.errstate(over="ignore"):
            keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.bits = 22
        first = np.searchsorted(self.keys >> np.uint64(64 - 16), np.arange(1 << 16, dtype=np.uint64))
        self.first = np.append(first, len(keys)).astype(np.int32)
        self.deep = int(np.diff(self.first).max()) if len(keys) else 0

    def _key(self, piece: str) -> int:
        key = np.uint64(len(piece))
        for c in piece:
            key = self._step(key, np.uint64(ord(c)))
        return key

    def _step(self, key, code):
        with np.errstate(over="ignore"):
            key = (key ^ code) * self.BASE
            return key ^ (key >> np.uint64(32))

    def numbers(self, codes: np.ndarray, size: int) -> np.ndarray:
        """codes: words by positions; the piece number of the ``size`` letters from each position on."""
        wide = codes.shape[1] - size + 1
        key = np.full((codes.shape[0], wide), np.uint64(size))
        for k in range(size):
            key = self._step(key, codes[:, k : k + wide])
        at = self.first[(key >> np.uint64(48)).astype(np.int64)]
        out = np.full(key.shape, self.unknown if size == 1 else self.none, np.int32)
        for d in range(self.deep):
            spot = np.minimum(at + d, len(self.keys) - 1)
            same = self.keys[spot] == key
            out[same] = self.order[spot[same]]
        return out


def _code_matrix(words: list[str]) -> np.ndarray:
    wide = max(map(len, words))
    return np.array(words, dtype=f"<U{wide}").view("<u4").reshape(len(words), wide).astype(np.uint64)


def _steps(pieces: Pieces, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each end position: (size, the words that have a piece of that size there, the pieces' numbers)."""
    wide = codes.shape[1]
    out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(wide + 1)]
    for size in range(1, min(pieces.longest, wide) + 1):
        numbers = pieces.numbers(codes, size)
        at, word = np.nonzero((numbers != pieces.none).T)
        edges = np.searchsorted(at, np.arange(wide - size + 2))
        for k in range(wide - size + 1):
            if edges[k] < edges[k + 1]:
                rows = word[edges[k] : edges[k + 1]]
                out[k + size].append((size, rows, numbers[rows, k]))
    return out


def forward(pieces: Pieces, probs: np.ndarray, words: list[str], edges: bool = False):
    """log probability of each word in each language (rows by columns); with ``edges`` also alphas and the steps.

    Without ``edges`` the last alphas are scaled up together whenever they get small, so nothing underflows.
    """
    codes = _code_matrix(words)
    n, wide = codes.shape
    lengths = np.fromiter(map(len, words), np.int64, n)
    steps = _steps(pieces, codes)
    if edges:
        alpha = np.zeros((wide + 1, n, probs.shape[1]))
        alpha[0] = 1.0
        for k in range(1, wide + 1):
            for size, rows, ids in steps[k]:
                alpha[k][rows] += alpha[k - size][rows] * probs[ids]
        return alpha[lengths, np.arange(n)], lengths, alpha, steps
    keep = pieces.longest + 1
    last = np.zeros((keep, n, probs.shape[1]))  # alphas of the last positions, in a ring
    last[0] = 1.0
    scale, out = np.zeros((n, probs.shape[1])), np.zeros((n, probs.shape[1]))
    for k in range(1, wide + 1):
        now = last[k % keep]
        now[:] = 0.0
        for size, rows, ids in steps[k]:
            now[rows] += last[(k - size) % keep][rows] * probs[ids]
        ends = lengths == k
        out[ends] = np.log(np.maximum(now[ends], 1e-300)) + scale[ends]
        top = last.max(0)
        if top.min() < 1e-100:
            factor = np.where(top < 1e-100, 1 / np.maximum(top, 1e-290), 1.0)
            last *= factor
            scale -= np.log(factor)
    return out


def expected(pieces: Pieces, probs: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected piece counts by language over all segmentations; weights: words by languages."""
    total = np.zeros_like(probs)
    for at in range(0, len(words), 4096):
        part, w = words[at : at + 4096], weights[at : at + 4096]
        ends, lengths, alpha, steps = forward(pieces, probs, part, edges=True)
        n, wide = len(part), alpha.shape[0] - 1
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(n)] = w / np.maximum(ends, 1e-300)
        for k in range(wide, 0, -1):  # beta at k is whole when its turn comes: pieces that begin there end further on
            for size, rows, ids in steps[k]:
                gain = probs[ids] * beta[k][rows]
                beta[k - size][rows] += gain
                gain *= alpha[k - size][rows]
                for lang in range(probs.shape[1]):
                    total[:, lang] += np.bincount(ids, gain[:, lang], minlength=len(total))
    return total


class LanguageModel:
    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.pieces, self.probs, self.key = languages, pieces, probs, uuid.uuid4().hex

    def scorer(self) -> _Scorer:
        return per_worker("language", self.key, lambda: _Scorer(self))


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.model, self.index = model, Pieces(model.pieces)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.model.languages)))
        self.bulky = 0  # letters of long words in the memo

    def _learn(self, words: set[str]) -> None:
        fresh = sorted(words - self.ids.keys(), key=len)
        if len(self.ids) + len(fresh) > len(self.logs):
            more = np.zeros((2 * (len(self.ids) + len(fresh)), self.logs.shape[1]))
            more[: len(self.ids)] = self.logs[: len(self.ids)]
            self.logs = more
        while fresh:  # by length, as many as their letters allow: a word of a million letters stands alone
            n = min(len(fresh), 4096)
            while n > 1 and n * len(fresh[n - 1]) > BATCH_LETTERS:
                n = n // 2
            part, fresh = fresh[:n], fresh[n:]
            first = len(self.ids)
            self.logs[first : first + n] = forward(self.index, self.model.probs, part)
            self.ids.update(zip(part, range(first, first + n), strict=True))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [("und", 0.0)] * len(texts)
        if len(self.ids) > MEMO_WORDS or self.bulky > MEMO_WORDS:
            self._reset()
        split = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        every = set().union(*split)
        self.bulky += sum(len(w) for w in every if len(w) > MEMO_LENGTH)
        self._learn(every)
        out, get = [], self.ids.__getitem__
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            logs = self.logs[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            best = int(logs.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(logs - logs[best]).sum())))
        return out


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = "piece_bpe_32k.model") -> LanguageModel:
    """Learn from rows of ``docs`` where ``train`` holds and the language is known."""
    rows = docs.filter(train & F.col(f"`{lang_col}`").isNotNull())
    rows = pick(rows, doc_id=id_col, text=text_col, lang=lang_col)
    spark = docs.sparkSession
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not sizes:
        return LanguageModel([], [], np.zeros((0, 0)))
    languages = [r["lang"] for r in sizes]
    rates = spark.createDataFrame([(r["lang"], min(1.0, SAMPLE_DOCS / r["count"])) for r in sizes], "lang string, rate double")
    some = rows.join(F.broadcast(rates), "lang").filter(share(F.col("doc_id"), 31) < F.col("rate"))
    words = some.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word"))
    words = words.filter(F.length("word") <= FIT_LETTERS).groupBy("lang", "word").count()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    words = words.withColumn("nth", first).filter(F.col("nth") <= SAMPLE_WORDS).select("lang", "word", "count").collect()
    pieces = vocabulary_pieces(vocabulary)
    pieces += sorted({c for r in words for c in r["word"]} - set(pieces))
    index = Pieces(pieces)
    every = sorted({r["word"] for r in words}, key=lambda w: (len(w), w))
    place = {w: i for i, w in enumerate(every)}
    column = {lang: i for i, lang in enumerate(languages)}
    weights = np.zeros((len(every), len(languages)))
    for r in words:
        weights[place[r["word"]], column[r["lang"]]] += r["count"]
    singles = np.array([len(p) == 1 for p in pieces] + [False, False])
    probs = np.zeros((len(pieces) + 2, len(languages)))
    probs[:-2] = 1 / len(pieces)
    probs[-2] = UNKNOWN
    for _ in range(ROUNDS):
        counts = expected(index, probs, every, weights)
        counts[singles] += SMOOTH
        counts[-2:] = 0
        probs = counts / counts.sum(0)
        probs[:-2] = np.maximum(probs[:-2], UNKNOWN)
        probs[-2], probs[-1] = UNKNOWN, 0.0
    return LanguageModel(languages, pieces, probs)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the posterior of the predicted language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary: bounded by the vocabulary file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or shared.value.scorer()
            for part in by_bytes(batch, "text", PART):
                found = scorer.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a known language (not ``und``, score at least ``least``), with the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or shared.value.scorer()
            for part in by_bytes(batch, text_col, PART):
                found = scorer.score(part.column(at_text).to_pylist())
                yield part.filter(pa.array([lang != "und" and score >= least for lang, score in found]))

    return docs.mapInArrow(work, docs.schema)
