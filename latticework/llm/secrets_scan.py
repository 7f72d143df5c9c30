"""Secret scans: fixed patterns, and a randomness test battery over long runs of token characters.

Candidates come from one vectorised pass over a batch's bytes: runs of RUN token characters or more. Fixed
patterns look at these runs, or at texts that hold a key word. The battery infers a run's encoding and tests it
against ordinary text: chi-squared uniformity over the encoding's alphabet, runs of character classes (of vowels and consonants
and the share of rare letters, where a run is letters of one case), and serial correlation give p-values under the text model,
which are combined. A weighted Benjamini-Hochberg step over all tested runs of the table, with weights that grow with the
length, controls the false discoveries: a histogram of the p-values, of a fixed size, gives one threshold.

Two narrow passes, with the candidates written between them; only histogram bins are shuffled. Runs of fewer than RUN
characters are not tested, as the tests have no power there. Defined results: a null or empty text has no spans and the digest
of nothing; texts of any length are scanned whole; offsets are code points; rows that repeat are scanned each, and count each in
the control; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, pick

#: The base patterns, by kind, in order. Fixed values of the result's contract.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = ("passw", "secret", "token", "api")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Runs this long are candidates; tests on fewer characters have no power.
RUN = 20
#: Share of false discoveries among the runs that the battery adds.
FDR = 0.01
_TOKEN = np.zeros(256, bool)
_TOKEN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)] = True
#: Alphabets by encoding, the narrowest first.
ALPHABETS = {"lower": "abcdefghijklmnopqrstuvwxyz", "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_PLACE = {k: np.array([max(0, v.find(chr(b))) for b in range(256)]) for k, v in ALPHABETS.items()}
#: The text model: chance that two characters of a text agree, and that neighbours differ in class; of letters of one case, the
#: chance that neighbours are vowel and consonant, and the share of the letters that are rare in most Latin scripts.
TEXT_AGREE, TEXT_CHANGE = 0.066, 0.08
TEXT_TURN, TEXT_RARE = 0.58, 0.10
_VOWELS, _RARE = frozenset("aeiouy"), frozenset("jkqvwxyz")
#: Bins of the histogram to a halving of p.
BINS = 32


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _binomial_tail(n: int, p: float, least: int) -> float:
    """P(at least ``least`` of n); by the normal curve beyond 400."""
    if least <= 0:
        return 1.0
    if n > 400:
        return _normal((n * p - least + 0.5) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1)))


def encoding(run: str) -> str:
    """The narrowest encoding that has the run's characters. Letters of one case are so named, a capital first letter or not, unless
    they could be hexadecimal."""
    chars = frozenset(run)
    if run.isalpha() and not chars <= _SETS["hex"]:
        if run.isupper() or run[1:].islower():
            return "UPPER" if run.isupper() else "lower"
    return next(k for k, s in _SETS.items() if k not in ("lower", "UPPER") and chars <= s)


def battery(run: str) -> tuple[str, float]:
    """(encoding, p): p is small if the run is unlike text and like the encoding of random bytes."""
    kind = encoding(run)
    letters = kind in ("lower", "UPPER")
    if letters:
        run = run.lower() if kind == "lower" else run
    alphabet = ALPHABETS[kind]
    k, n = len(alphabet), len(run)
    values = np.frombuffer(run.encode(), np.uint8)
    values = _PLACE[kind][values]
    counts = np.bincount(values, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    excess = max(k * TEXT_AGREE - 1, 0.5)
    p_chi = _normal((chi - (k - 1) - (n - 1) * excess) / math.sqrt(2 * (k - 1) + 4 * n * excess + 2 * n * excess**2))
    too_uneven = 1 - _normal((chi - (k - 1)) / math.sqrt(2 * (k - 1)))
    centred = values - values.mean()
    spread = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / spread if spread else 1.0
    too_ordered = 2 * (1 - _normal(abs(serial + 1 / n) * math.sqrt(n)))
    tests = [p_chi, max(1e-3, 1 - too_ordered)]
    if letters:
        low = run.lower()
        turns = sum((a in _VOWELS) != (b in _VOWELS) for a, b in zip(low, low[1:], strict=False))
        tests += [_binomial_tail(n - 1, 1 - TEXT_TURN, n - 1 - turns), _binomial_tail(n, TEXT_RARE, sum(c in _RARE for c in low))]
    else:
        classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in run if c.isalnum()]  # marks join words in texts
        changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
        tests.append(_binomial_tail(max(len(classes) - 1, 1), TEXT_CHANGE, changes))
    if too_uneven < 1e-4 or too_ordered < 1e-3:  # unlike random bytes in this encoding
        return kind, 1.0
    half = -sum(math.log(max(p, 1e-300)) for p in tests)  # Fisher: half a chi-squared statistic with two degrees of freedom a test
    return kind, min(1.0, math.exp(-half) * sum(half**j / math.factorial(j) for j in range(len(tests))))


def weight(n: int) -> float:
    """What the p-value of a run of n characters is divided by, relative to the mean weight."""
    return math.sqrt(n)


def p_bin(n: int, p: float) -> int:
    """The bin of p over the run's weight: numbers grow as it gets smaller."""
    return math.floor(-math.log2(max(p, 1e-300) / weight(n)) * BINS)


def threshold(bins: list[tuple[int, int]], mean_weight: float, level: float = FDR) -> int | None:
    """The least bin whose runs are discoveries, by the Benjamini-Hochberg step over (bin, runs); None if there are none."""
    total, below, out = sum(n for _, n in bins), 0, None
    for b, n in sorted(bins, reverse=True):
        below += n
        if 2.0 ** (-b / BINS) * mean_weight <= level * below / total:  # the greatest weighted p in the bin
            out = b
    return out


def discoveries(tested: list[tuple[int, float]], level: float = FDR) -> list[bool]:
    """The control over a list of (length, p), as ``secret_spans`` does it over a table."""
    if not tested:
        return []
    found = [p_bin(n, p) for n, p in tested]
    least = threshold([(b, 1) for b in found], sum(weight(n) for n, _ in tested) / len(tested), level)
    return [least is not None and b >= least for b in found]


def scan(text: str, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, float]]]:
    """(base spans, tested runs with their p) of a text; runs are offsets of its candidate runs in code points."""
    base: list[tuple[int, int, str]] = []
    if (":" in text or "=" in text) and any(w in low for low in (text.lower(),) for w in _KEYWORDS):
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    tested = []
    for start, end in runs:
        run = text[start:end]
        for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
            base += [(start + m.start(), start + m.end(), kind) for m in pattern.finditer(run) if m.end() - m.start() >= LEAST[kind]]
        tested.append((start, end, battery(run)[1]))
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return base, [(a, b, p) for a, b, p in tested if not any(s <= a and b <= e for s, e, _ in base)]


def candidate_runs(raws: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text's bytes the code point offsets of its runs of RUN token characters or more."""
    flat = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    stops = np.flatnonzero(~_TOKEN[flat])
    begins = np.concatenate([[0], stops[:-1] + 1])
    long = stops - begins >= RUN
    begins, stops = begins[long], stops[long]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    owner = np.searchsorted(offsets, begins, side="right") - 1
    points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])  # code points before each byte
    first = points[begins] - points[offsets[owner]]
    out: list[list[tuple[int, int]]] = [[] for _ in raws]
    for o, a, n in zip(owner.tolist(), first.tolist(), (stops - begins).tolist(), strict=True):
        out[o].append((a, a + n))
    return out


_SPAN = "array<struct<start: long, end: long, kind: string>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = FDR) -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of start, end, kind; base spans by start and kind, then added ones in place), base (their joined form), spans (all, joined)."""
    spark = docs.sparkSession
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bin", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                bases, tested = [], []
                for t, runs in zip(texts, candidate_runs([t.encode() for t in texts]), strict=True):
                    base, candidates = scan(t, runs)
                    bases.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                    tested.append([{"start": a, "end": b, "bin": p_bin(b - a, p)} for a, b, p in candidates])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bases, span), pa.array(tested, run)], ["doc_id", "base", "tested"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    scanned = materialize(spark, rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, base {_SPAN}, tested array<struct<start: long, end: long, bin: long>>"), "scanned")
    every = scanned.select(F.explode("tested").alias("t")).select("t.bin", F.sqrt(F.col("t.end") - F.col("t.start")).alias("w"))
    bins = every.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()  # at most BINS a halving of p: some 32 000 rows
    total = sum(r["n"] for r in bins)
    least = threshold([(r["bin"], r["n"]) for r in bins], sum(r["w"] for r in bins) / total, level) if total else None
    added = F.filter("tested", lambda t: F.lit(least is not None) & (t["bin"] >= F.lit(least or 0)))
    ranked = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), kind(s).alias("rank"), s["end"].alias("end")))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    both = F.array_sort(F.concat(ranked("base", rank), ranked(added, lambda s: F.lit(len(KINDS) + 1).cast("long"))))
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "random")]), s["rank"].cast("int"))
    found = F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), name(s).alias("kind")))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select("doc_id", "base", found.alias("found")).select("doc_id", "found", joined("base").alias("base"), joined("found").alias("spans"))
