"""Toxicity by a linear-chain conditional random field over words.

Labelled tokens: a bounded sample of labelled documents (SAMPLE_TOXIC and SAMPLE_CLEAN of each label by hash of the
id, none above SAMPLE_POINTS code points) tells which word features (the word, its first 3 to 6 letters) stand in
toxic documents far more often than chance allows; words with such a feature in a toxic document are labelled toxic.
The field has two states, emissions from hashed features of the word and transitions; it is fitted by gradient steps
on the exact likelihood. Forward-backward marginals say which words are toxic: their offsets are the offending spans,
and the document score is the chance that one of its TOP likeliest words is toxic, on a logistic scale
fitted to the sample's document labels.

The chain is summed block by block (products of 2 x 2 matrices), so a very long text costs no more per word. Scoring is a
scan without shuffle; each worker keeps a bounded memo of words. Defined results: a null text, or one without words,
has score 0 and no spans; with no toxic or no clean document to learn from every score is 0; repeated labels of an
id count as toxic if any is; rows that repeat are scored each; other columns are never inputs.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import MEMO_ENTRIES
from .common import by_bytes, per_worker, pick, share

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_POINTS = 2000, 4000, 12_000
FIT_TOKENS, STEPS, RATE, DECAY = 300_000, 80, 0.7, 1e-6
DIMENSIONS, BLOCK, TOP = 1 << 18, 64, 5
#: A span is reported where the marginal reaches this.
SPAN_LEAST = 0.5
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def features(word: str) -> list[str]:
    return [f"w:{word}", *(f"p:{word[:k]}" for k in range(3, min(6, len(word)) + 1))]


def _hashed(word: str) -> list[int]:
    names = features(word) + [f"s:{word[-3:]}", f"n:{min(len(word), 12)}"]
    return [zlib.crc32(n.encode()) % DIMENSIONS for n in names]


def marginals(odds: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For chains laid end to end: P(state 1) of each place, expected transitions (2 x 2) and the sum of log Z.

    odds: exp(emission of state 1 less that of state 0); trans: exp of the transition weights. Each chain is cut into
    blocks of BLOCK places; blocks are multiplied side by side, then chained, then walked in both directions.
    """
    n_blocks = -(-lengths // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    owner = np.repeat(np.arange(len(lengths)), n_blocks)
    nth = np.arange(first_block[-1]) - first_block[owner]
    begin = starts[owner] + nth * BLOCK
    size = np.minimum(BLOCK, lengths[owner] - nth * BLOCK)
    cols = np.arange(BLOCK)
    live = cols < size[:, None]
    grid = np.where(live, begin[:, None] + cols, 0)
    e = np.where(live, odds[grid], 1.0).T.copy()  # place by block
    live = live.T
    nb = len(size)
    # Block products, rescaled at each place.
    prod = np.tile(np.eye(2)[:, :, None], (1, 1, nb))
    for k in range(BLOCK):
        step = np.einsum("ijb,jk->ikb", prod, trans)
        step[:, 1] *= e[k]
        step /= step.max((0, 1))
        prod = np.where(live[k], step, prod)
    # Vectors that enter each block from the left and the right.
    left, right = np.ones((2, nb)), np.ones((2, nb))
    left[0] = 1.0 / trans.sum(0).max()
    enter = np.linalg.solve(trans.T, np.ones(2)) if abs(np.linalg.det(trans)) > 1e-9 else np.ones(2)
    left[:] = enter[:, None]  # so that the first place sees (1, 1) after the transition
    most = int(n_blocks.max()) if len(n_blocks) else 0
    for k in range(1, most):
        b = first_block[:-1][n_blocks > k] + k
        v = np.einsum("ib,ijb->jb", left[:, b - 1], prod[:, :, b - 1])
        left[:, b] = v / np.abs(v).max(0)
    for k in range(most - 2, -1, -1):
        b = first_block[:-1][n_blocks > k + 1] + k
        v = np.einsum("ijb,jb->ib", prod[:, :, b + 1], right[:, b + 1])
        right[:, b] = v / np.abs(v).max(0)
    fwd, bwd = np.empty((BLOCK, 2, nb)), np.empty((BLOCK, 2, nb))
    before = np.empty((BLOCK, 2, nb))
    log_z = np.zeros(nb)
    v = left
    for k in range(BLOCK):
        before[k] = v
        step = trans.T @ v
        step[1] *= e[k]
        scale = step.max(0)
        log_z += np.where(live[k], np.log(np.maximum(scale, 1e-300)), 0.0)
        v = np.where(live[k], step / scale, v)
        fwd[k] = v
    u = right
    for k in range(BLOCK - 1, -1, -1):
        bwd[k] = u
        w = u.copy()
        w[1] *= e[k]
        step = trans @ w
        u = np.where(live[k], step / np.maximum(step.max(0), 1e-300), u)
    both = fwd * bwd
    p = both[:, 1] / both.sum(1)
    pair = before[:, :, None, :] * trans[None, :, :, None] * bwd[:, None, :, :]
    pair[:, :, 1] *= e[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    inner = live & ~((nth == 0)[None, :] & (cols == 0)[:, None])
    expected = np.einsum("kijb,kb->ij", pair, inner.astype(float))
    out = np.empty(len(odds))
    flat = live.T
    out[grid[flat]] = p.T[flat]
    return out, expected, float(log_z.sum())


class ToxicModel:
    """Emission weights over hashed features, a bias, and transition weights."""

    def __init__(self, weights: np.ndarray | None, bias: float, trans: np.ndarray):
        self.weights, self.bias, self.trans, self.scale, self.key = weights, bias, trans, (1.0, 0.0), uuid.uuid4().hex


def label_words(docs: list[list[str]], toxic: list[bool]) -> set[str]:
    """Features that stand in toxic documents more often than chance allows, over all features tested (Bonferroni)."""
    in_toxic, in_clean, around = Counter(), Counter(), Counter()
    for words, label in zip(docs, toxic, strict=True):
        (in_toxic if label else in_clean).update({f for w in set(words) for f in features(w)})
    # Copies of one text are one witness: a feature counts as often as it has different neighbours, at most.
    place = {w: i for i, w in enumerate({w for words, label in zip(docs, toxic, strict=True) if label for w in words})}
    names = list(place)
    ids = np.fromiter((i for words, label in zip(docs, toxic, strict=True) if label for i in (-1, *map(place.__getitem__, words), -1)), np.int64)
    if len(ids) > 2:
        with np.errstate(over="ignore"):
            seen = np.unique(np.stack([ids[1:-1], (ids[:-2] + 7) * np.int64(0x9E3779B97F4A7) ^ (ids[2:] + 7) * np.int64(0xD6E8FEB86659F)], 1)[ids[1:-1] >= 0], axis=0)
        for i, n in enumerate(np.bincount(seen[:, 0], minlength=len(names)).tolist()):
            for f in features(names[i]):
                around[f] += n
    in_toxic = Counter({f: min(n, around[f]) for f, n in in_toxic.items()})
    n_toxic = sum(toxic)
    base = n_toxic / len(toxic)
    limit = math.log(0.05 / max(1, len(in_toxic) + len(in_clean)))
    out = set()
    for f, k in in_toxic.items():
        n = k + in_clean[f]
        rate = k / n
        if rate < 0.97:
            continue
        # Chernoff's bound for k or more of n at the base rate.
        divergence = rate * math.log(rate / base) + ((1 - rate) * math.log((1 - rate) / (1 - base)) if rate < 1 else 0.0)
        if -n * divergence < limit:
            out.add(f)
    return out


def fit_words(docs: list[list[str]], toxic: list[bool]) -> ToxicModel:
    if not any(toxic) or all(toxic):
        return ToxicModel(None, 0.0, np.zeros((2, 2)))
    marked = label_words(docs, toxic)
    # Toxic documents first, then clean ones in turn, up to the budget of words.
    order = [i for pair in zip([i for i, t in enumerate(toxic) if t], [i for i, t in enumerate(toxic) if not t], strict=False) for i in pair]
    chosen, budget = [], FIT_TOKENS
    for i in order:
        if docs[i] and len(docs[i]) <= budget:
            chosen.append(i)
            budget -= len(docs[i])
    words = sorted({w for i in chosen for w in docs[i]})
    place = {w: k for k, w in enumerate(words)}
    hashed = [_hashed(w) for w in words]
    flat = np.array([h for hs in hashed for h in hs])
    owner = np.repeat(np.arange(len(words)), [len(h) for h in hashed])
    hot = np.array([any(f in marked for f in features(w)) for w in words])
    lengths = np.array([len(docs[i]) for i in chosen])
    ids = np.fromiter((place[w] for i in chosen for w in docs[i]), np.int64, int(lengths.sum()))
    labels = hot[ids] & np.repeat([toxic[i] for i in chosen], lengths)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1].astype(int), labels[at].astype(int)), 1)
    weights, trans = np.zeros(DIMENSIONS), np.zeros((2, 2))
    grads = [np.full(DIMENSIONS, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    gold = np.bincount(ids, labels, minlength=len(words))
    bias = math.log((gold.sum() + 1) / len(ids)) - 1
    for _ in range(STEPS):
        emission = np.bincount(owner, weights[flat], minlength=len(words)) + bias
        p, pairs, _ = marginals(np.exp(np.clip(emission, -30, 30))[ids], lengths, np.exp(trans))
        miss = gold - np.bincount(ids, p, minlength=len(words))
        steps = [np.bincount(flat, miss[owner], minlength=DIMENSIONS) - DECAY * len(ids) * weights, miss.sum(), seen - pairs - DECAY * len(ids) * trans]
        for k, g in enumerate(steps):
            grads[k] = grads[k] + g * g
        weights += RATE * steps[0] / np.sqrt(grads[0])
        bias += RATE * steps[1] / math.sqrt(grads[1])
        trans += 0.2 * steps[2] / np.sqrt(grads[2])
    model = ToxicModel(weights.astype(np.float32), float(bias), trans)
    scorer, raw = _Scorer(model), []
    for i in range(0, len(docs), 256):
        raw += [raw_score(p) for p in scorer.marginals(docs[i : i + 256])]
    model.scale = calibrate(np.array(raw), np.array(toxic, float))
    return model


def raw_score(p: np.ndarray) -> float:
    """Log-odds that one of the TOP likeliest words is toxic."""
    if not len(p):
        return -15.0
    top = np.partition(p, len(p) - TOP)[-TOP:] if len(p) > TOP else p
    none = float(np.log1p(-np.minimum(top, 1 - 1e-7)).sum())
    return min(15.0, max(-15.0, math.log(max(-math.expm1(none), 1e-7)) - none))


def calibrate(raw: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from a document's log-odds to its label; Newton steps with a small ridge."""
    x = np.stack([raw, np.ones_like(raw)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, x.T @ (p - toxic) + 0.5 * (beta - [1.0, 0.0])), -1, 1)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0.1 else (1.0, 0.0)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Learn from labelled documents for whose ``doc_id`` the column ``train`` holds."""
    known = pick(labels, doc_id=id_col, toxic=label_col).filter("doc_id is not null and toxic is not null").filter(train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return ToxicModel(None, 0.0, np.zeros((2, 2)))
    rate = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_TOXIC / counts[1])).otherwise(min(1.0, SAMPLE_CLEAN / counts[0]))
    some = known.filter(share(F.col("doc_id"), 29) < rate)
    # At most about SAMPLE_TOXIC + SAMPLE_CLEAN ids of 8 bytes: the bound of the broadcast.
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(some), "doc_id").filter(F.length("text") <= SAMPLE_POINTS)
    rows = sorted(rows.select("doc_id", "text", "toxic").collect())
    return fit_words([words_of(r[1]) for r in rows], [r[2] == 1 for r in rows])


class _Scorer:
    def __init__(self, model: ToxicModel):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.odds: list[float] = []

    def marginals(self, split: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > MEMO_ENTRIES:
            self._reset()
        fresh = list({w for words in split for w in words} - self.ids.keys())
        if fresh:
            hashed = [_hashed(w) for w in fresh]
            owner = np.repeat(np.arange(len(fresh)), [len(h) for h in hashed])
            sums = np.bincount(owner, self.model.weights[np.array([h for hs in hashed for h in hs])], minlength=len(fresh)) + self.model.bias
            self.ids.update(zip(fresh, range(len(self.odds), len(self.odds) + len(fresh)), strict=True))
            self.odds.extend(np.exp(np.clip(sums, -30, 30)).tolist())
        lengths = np.array([len(w) for w in split if w], np.int64)
        total = int(lengths.sum())
        get = self.ids.__getitem__
        places = np.fromiter((get(w) for words in split for w in words), np.int64, total)
        p = marginals(np.array(self.odds)[places], lengths, np.exp(self.model.trans))[0] if total else np.zeros(0)
        out, at = [], 0
        for words in split:
            out.append(p[at : at + len(words)])
            at += len(words)
        return out


def toxic_spans(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, spans (array of start, end, p for the words whose marginal is SPAN_LEAST or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights of 4 bytes: 1 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            scorer = scorer or per_worker("toxicity", shared.value.key, lambda: _Scorer(shared.value))
            for part in by_bytes(batch, "text", 1 << 20):
                texts = [t.as_py() or "" for t in part.column("text")]
                split = [words_of(t) for t in texts]
                if scorer.model.weights is None:
                    found = [np.zeros(len(w)) for w in split]
                else:
                    found = scorer.marginals(split)
                scores, spans = [], []
                for t, p in zip(texts, found, strict=True):
                    slope, offset = scorer.model.scale
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, slope * raw_score(p) + offset)))) if len(p) and scorer.model.weights is not None else 0.0)
                    hits = np.flatnonzero(p >= SPAN_LEAST)
                    if len(hits):
                        lower = t.lower()
                        ms = list(_WORDS.finditer(lower if len(lower) == len(t) else t))
                        spans.append([{"start": ms[k].start(), "end": ms[k].end(), "p": float(p[k])} for k in hits.tolist() if k < len(ms)])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, spans array<struct<start: long, end: long, p: double>>")


def joined_spans(spans: str):
    """The spans as start:end, comma-joined; code points, end exclusive."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
