"""Quality classifier from weak labels.

1. Ten heuristic labellers vote good, bad or abstain on every document (one Arrow pass).  Only the
   counts of vote patterns leave the tasks: at most 3 ** 10 of them, whatever the input.
2. Expectation-maximisation over the pattern counts (Dawid and Skene's model; abstentions say
   nothing) estimates how reliable each labeller is in each class, and the posterior of a pattern.
3. Posteriors of a bounded sample (``SAMPLE`` rows expected, chosen by hash) are the soft labels of
   a hashed linear scorer: logistic regression on hashed word shapes, shape pairs and word repeats.
4. The scorer rates every document; ``keep`` is score >= ``threshold``.

No stage moves text.  Counts cover all rows; the sample bounds only the fit of the scorer.

Defined results: null text counts as empty; a text without words gets no votes, and its score is
that of the scorer's intercept and its "no words" feature; repeated rows get equal scores; an empty
table gives an empty table (the scorer then knows nothing and scores 0.5).
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, pack, pick, prepare, text_of

SAMPLE = 6000
DIM = 1024
#: A text goes only if the scorer is fairly sure that it is bad.
THRESHOLD = 0.3
BAD, GOOD, ABSTAIN = 0, 1, 2

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_OTHER = np.zeros(256, bool)
_OTHER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b".,;:?!'\"()-")] = True
_SIGN = ~(_UPPER | _LOWER | _OTHER | _DIGIT | _BLANK | _PLAIN)

#: Frequent function words of some European languages (our own choice).
COMMON = frozenset("""the of and to in is that for it with as on by this from are was be or an
der die das und ist von mit den ein eine nicht für auf im
le la les des et en un une que qui dans pour est du sur
el los de y se del por con una para al más""".split())


def _vote(value: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(text: str) -> list[int]:
    """The votes of all labellers on one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [ABSTAIN] * 10
    hist = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower = int(hist[_UPPER].sum()), int(hist[_LOWER].sum())
    solid = int(hist[~_BLANK].sum())
    signs = int(hist[_SIGN].sum()) / n
    rows = hist[ord("|")] / n
    shout = hist[ord("!")] / n
    loud = upper / max(1, upper + lower)
    same = sum(map(operator.eq, words, words[1:])) / max(1, n - 1)
    kinds = len(set(words))
    rich = kinds / n ** 0.5
    wordy = int((hist * (_UPPER | _LOWER | _OTHER)).sum()) / solid
    stops = hist[ord(".")] / n
    lines = [x for x in text.split("\n") if x]
    again = 1 - len(set(lines)) / max(1, len(lines))
    size = solid / n
    common = sum(w.lower() in COMMON for w in words[:]) / n if n >= 30 else None
    return [
        _vote(signs, signs < 0.05, signs > 0.3),
        _vote(rows, n >= 10 and rows < 0.02, rows > 0.2),
        _vote(shout, n >= 10 and shout < 0.1, shout > 0.5),
        _vote(loud, loud < 0.25, n >= 5 and loud > 0.6),
        _vote(same, n >= 10 and same < 0.05, n >= 5 and same > 0.3),
        _vote(rich, n >= 20 and rich > 4, n >= 60 and rich < 2.2),
        _vote(wordy, wordy > 0.9, wordy < 0.75),
        _vote(stops, n >= 10 and 0.02 < stops < 0.5, n >= 40 and stops < 0.004),
        _vote(again, len(lines) >= 4 and again < 0.2, len(lines) >= 4 and again > 0.8),
        ABSTAIN if common is None else _vote(common, common > 0.1, common < 0.02 or size > 15),
    ]


def _code(v: list[int]) -> int:
    return functools.reduce(lambda a, b: a * 3 + b, v, 0)


#: What a byte counts as in a word's shape: runs of capitals, of small letters and of digits become
#: one sign each, other signs stay, white space parts words.
_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[_UPPER], _SIGNS[_LOWER | _OTHER], _SIGNS[_DIGIT], _SIGNS[_BLANK] = ord("A"), ord("a"), ord("0"), ord(" ")
_LONGEST = 8
_MIX = np.random.default_rng(1).integers(1, 1 << 62, (_LONGEST, 256), dtype=np.int64)


def shapes(raw: bytes) -> np.ndarray:
    """A hash of the shape of each word (its first ``_LONGEST`` signs)."""
    signs = _SIGNS[np.frombuffer(raw, np.uint8)]
    signs = signs[np.flatnonzero(np.diff(signs, prepend=ord(" ")))]
    blank = signs == ord(" ")
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.empty(0, np.int64)
    word = np.cumsum(np.bincount(starts, minlength=len(signs))) - 1
    place = np.arange(len(signs)) - starts[word]
    value = np.where(blank | (place >= _LONGEST), 0, _MIX[np.minimum(place, _LONGEST - 1), signs])
    return np.add.reduceat(value, starts) >> 20


def features(text: str) -> np.ndarray:
    """Hashed features: square roots of the shares of shapes, shape pairs and repeats."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    x = np.zeros(DIM, np.float32)
    if not n:
        x[0] = 1
        return x
    kinds = shapes(raw)
    x += np.bincount(1 + kinds % (DIM // 2 - 2), minlength=DIM)
    x += np.bincount(DIM // 2 + (kinds[:-1] * 31 + kinds[1:] * 17) % (DIM // 2 - 1), minlength=DIM)
    x[DIM - 1] = sum(map(operator.eq, words, words[1:]))
    return np.sqrt(x / (n + 8))  # short texts say less


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray, np.ndarray]:
    """EM.  patterns: (m, k) votes; counts: (m,).  Returns the share of good texts, vote
    probabilities (2, k, 2) and the posterior of good for each pattern."""
    m, k = patterns.shape
    hot = np.eye(3)[patterns][:, :, :2]  # (m, k, 2); an abstention is a row of zeros
    bad, good = (patterns == BAD).sum(1), (patterns == GOOD).sum(1)
    post = np.clip(0.5 + 0.5 * (good + 1 - 4.0 * bad) / (good + 1 + 4.0 * bad), 0.02, 0.98)
    # weak prior counts: a labeller is rather right than wrong, and few votes settle nothing
    prior = np.array([[4.0, 4.0], [1.0, 20.0]])
    share, table = 0.5, np.full((2, k, 2), 0.5)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])  # (2, m)
        share = (weight[1].sum() + 9) / (counts.sum() + 10)
        table = np.einsum("cm,mko->cko", weight, hot) + prior[:, None, :]
        table /= table.sum(2, keepdims=True)
        # anchors: faults are of several kinds, so a labeller misses at least half of the bad texts,
        # and it blames at most a tenth of the good ones
        table[0, :, BAD], table[1, :, BAD] = np.minimum(table[0, :, BAD], 0.5), np.minimum(table[1, :, BAD], 0.1)
        table[:, :, GOOD] = 1 - table[:, :, BAD]
        loglik = np.einsum("mko,cko->cm", hot, np.log(table))
        odds = np.log(share) - np.log1p(-share) + loglik[1] - loglik[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
    return float(share), table, post


def fit_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Logistic regression with soft labels by accelerated gradient; the last weight is the intercept."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    each = np.full(len(y), 1 / len(y), np.float32)
    # the curvature is at most a quarter of the largest eigenvalue, which the weighted trace bounds
    step = np.float32(1 / (0.25 * float((each[:, None] * x * x).sum()) + ridge))
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (each * (p - y)) + np.float32(ridge) * np.append(v[:-1], np.float32(0))
        last, w = w, v - step * g
        v = w + np.float32(t / (t + 3)) * (w - last)
    return w.astype(float)


class Model:
    """Weights of the scorer, and what EM found about the labellers."""

    def __init__(self, weights: np.ndarray, share: float, table: np.ndarray):
        self.weights, self.share, self.table = weights, share, table

    def score(self, text: str) -> float:
        z = float(features(text) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Weak labels, EM and the scorer, from all rows' votes and a sample's features."""
    rows = pick(prepare(docs), text=text_of(docs, text))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for t in batch.column("text"):
                c = _code(votes(t.as_py()))
                seen[c] = seen.get(c, 0) + 1
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    got = rows.mapInArrow(tally, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes, counts = np.array([r["code"] for r in got], np.int64), np.array([r["n"] for r in got], float)
    patterns = codes[:, None] // 3 ** np.arange(9, -1, -1) % 3
    share, table, post = fit_labellers(patterns, counts)
    belief = dict(zip(codes.tolist(), post.tolist()))
    part = min(1.0, sample / max(counts.sum(), 1))
    chosen = rows if part == 1 else rows.filter(
        F.xxhash64("text", F.lit("sample")).bitwiseAND(F.lit((1 << 52) - 1)) < F.lit(int(part * (1 << 52))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "code": pa.array([_code(votes(t)) for t in texts], pa.int64()),
                "x": pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary())})

    seen = chosen.mapInArrow(describe, "code bigint, x binary").collect()  # about ``sample`` rows of 2 KB
    x = np.frombuffer(b"".join(r["x"] for r in seen), np.float16).reshape(-1, DIM).astype(np.float32)
    y = np.array([belief[r["code"]] for r in seen])
    order = np.lexsort((y, *x[:, :8].T)) if len(y) else []
    return Model(fit_scorer(x[order], y[order]) if len(y) else np.zeros(DIM + 1), share, table)


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column under a fitted model (a few KB, sent with the function)."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")

    return score(text)


def classify(docs: DataFrame, text: str = "text", doc: str = "doc_id", sample: int = SAMPLE,
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, keep."""
    model = fit(docs, text, sample)
    rows = pick(docs, doc_id=docs[doc].cast("long"), score=score_column(model, text_of(docs, text)))
    return rows.withColumn("keep", F.col("score") >= threshold)


def accepted(docs: DataFrame, text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text the scorer accepts (columns as given)."""
    model = fit(docs, text, sample)
    rows = pack(docs, score=score_column(model, text_of(docs, text)))
    return rows.filter(F.col("score") >= threshold).select(f"{ROW}.*")
