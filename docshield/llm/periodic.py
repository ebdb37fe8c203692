"""Periodic run detection in word sequences by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of
at least max(``least``, 3 q) words, which no neighbouring word extends keeping period q.

The words of a slice of documents become numbers in one array, with a number of its own between
two documents.  At each dyadic scale b = 8, 16, 32, ... the array is cut into aligned blocks of b
words.  A run whose period lies in [b, 2 b) (at b = 8: below 16) holds a whole block whose next
copy lies one period on, so the block is looked for in the 2 b - 1 words that begin b words after
it (at b = 8 also in those that begin with it).  The squared differences of block and window
words, summed for all b shifts at once by number-theoretic transforms, are zero exactly where the
block occurs: the sum is an integer below the product of the primes used, so it is zero if and
only if it vanishes modulo each.  The distances found are seeds: each is extended word by word to
the maximal stretch on which words that far apart agree.

Blocks are left out only where they cannot matter: a block holding a word that does not return
within 2 b - 1 words has no copy in its window; and by the theorem of Fine and Wilf a copy inside
a run of a smaller period, found at a smaller scale, begins no run of its own.

Texts are worked on in slices of about ``SLICE`` bytes; a longer text is a slice of its own, read
whole (its memory is about 100 bytes a word).  Tiles bound the memory of a transform.

Defined results: null text counts as empty and has no runs; a null id is carried as it is; repeated
rows each get their row; very long texts are read whole; an empty table gives an empty table; extra
columns of any name are ignored by the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, pick, prepare, text_of

#: Shortest run, in words, and smallest number of periods in one (fixed by the contract).
LEAST = 24
TIMES = 3
BASE = 8
#: Text bytes worked on at a time, and numbers in a tile of transforms.
SLICE = 4 << 20
TILE = 1 << 18
#: Words compared at a time while a seed is extended.
STEP = 32
#: Primes of the form c 2^k + 1 below 2^31 with a primitive root each (transforms of up to 2^23 words and more).
PRIMES = ((2013265921, 31), (469762049, 3), (998244353, 3), (167772161, 3))


def _less(x: np.ndarray, p: int) -> np.ndarray:
    """Numbers below 2 p, reduced below p in place."""
    np.subtract(x, p, out=x, where=x >= p)
    return x


@lru_cache(maxsize=256)
def _roots(size: int, p: int, root: int) -> np.ndarray:
    """The first ``size`` / 2 powers of a ``size``-th root of unity modulo p."""
    w = pow(root, (p - 1) // size, p)
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        out = np.concatenate((out, out * np.uint64(pow(w, len(out), p)) % np.uint64(p)))
    return out


def _forward(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Transform along the first axis, in bit-reversed order; ``x`` is overwritten."""
    size, rows = x.shape
    half = size // 2
    while half:
        v = x.reshape(size // (2 * half), 2, half, rows)
        a, c = v[:, 0], v[:, 1]
        diff = a + np.uint64(p) - c
        diff *= _roots(2 * half, p, root)[None, :, None]
        diff %= np.uint64(p)
        a += c
        _less(a, p)
        v[:, 1] = diff
        half //= 2
    return x


def _backward(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Inverse of ``_forward`` times the size."""
    size, rows = x.shape
    inverse = pow(root, p - 2, p)
    half = 1
    while half < size:
        v = x.reshape(size // (2 * half), 2, half, rows)
        a = v[:, 0]
        c = v[:, 1] * _roots(2 * half, p, inverse)[None, :, None] % np.uint64(p)
        low = a + c
        v[:, 1] = _less(a + np.uint64(p) - c, p)
        v[:, 0] = _less(low, p)
        half *= 2
    return x


def _zeros(blocks: np.ndarray, windows: np.ndarray, top: int) -> np.ndarray:
    """(shift, block) -> whether block (b words, one a column) equals its window (2 b - 1 words)
    from that shift on, by sums of squared differences; values are at most ``top``."""
    b, rows = blocks.shape
    bound, used = b * top * top, 1
    equal = np.ones((b, rows), bool)
    for p, root in PRIMES:
        q = np.uint64(p)
        squares = np.zeros((2 * b, rows), np.uint64)
        np.cumsum(windows * windows % q, axis=0, out=squares[1:])
        near = squares[b:2 * b] - squares[:b] + (blocks * blocks % q).sum(axis=0, dtype=np.uint64)
        x = np.zeros((2 * b, rows), np.uint64)  # the block reversed: a convolution then correlates
        x[0] = blocks[0] % q
        x[b + 1:] = blocks[:0:-1] % q
        y = np.zeros((2 * b, rows), np.uint64)
        y[:2 * b - 1] = windows % q
        z = _forward(x, p, root)
        z *= _forward(y, p, root)
        z %= q
        dots = _backward(z, p, root)[:b] * np.uint64(pow(2 * b, p - 2, p)) % q
        equal &= near % q == 2 * dots % q
        used *= p
        if used > bound:
            return equal
    raise ValueError("a block's words are too many for the primes")


def _extend(a: np.ndarray, place: np.ndarray, dist: np.ndarray, way: int) -> np.ndarray:
    """For each seed, how many words from ``place`` on (way 1) or before it (way -1) equal the
    word ``dist`` further on.  ``a`` is bounded by numbers that equal none."""
    n, out = len(a), np.zeros(len(place), np.int64)
    live = np.arange(len(place))
    steps = np.arange(STEP) if way > 0 else -1 - np.arange(STEP)
    while len(live):
        ahead = []
        for part in np.array_split(live, -(-len(live) // (TILE // STEP))):
            at = (place[part] + way * out[part])[:, None] + steps
            to = at + dist[part][:, None]
            same = (at >= 0) & (to < n)
            same &= a[np.clip(at, 0, n - 1)] == a[np.clip(to, 0, n - 1)]
            run = np.where(same.all(axis=1), STEP, (~same).argmax(axis=1))
            out[part] += run
            ahead.append(part[run == STEP])
        live = np.concatenate(ahead)
    return out


def find(a: np.ndarray, returns: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run in an array of numbers, by start, then period.
    ``returns``: how far on each word occurs next (a large number if never); ``longest``: the
    length of the longest document."""
    n = len(a)
    runs: dict[tuple[int, int], int] = {}
    b, far = BASE, None
    while (TIMES * b if b > BASE else least) <= longest:
        whole = n // b
        far = returns[:whole * b].reshape(whole, b).max(axis=1) if far is None else \
            np.maximum(far[0:2 * whole:2], far[1:2 * whole:2])
        reach = None
        if runs:  # how far the runs that begin at or before a word reach
            reach = np.zeros(n, np.int64)
            known = np.array([(s, s + m) for s, m in runs], np.int64)
            np.maximum.at(reach, known[:, 0], known[:, 1])
            reach = np.maximum.accumulate(reach)
        first = np.flatnonzero(far < 2 * b) * b
        if reach is not None and b > BASE:
            first = first[reach[first] < np.minimum(first + 3 * b - 1, n)]
        if len(first):
            seeds = _seeds(a, first, b)
            if reach is not None and b > BASE:
                seeds = seeds[reach[seeds[:, 0]] < seeds[:, 0] + seeds[:, 1] + b]
            _grow(a, seeds, b, least, runs)
        b *= 2
    out = np.array([(s, m, q) for (s, m), q in runs.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _seeds(a: np.ndarray, first: np.ndarray, b: int) -> np.ndarray:
    """(block start, distance) of the occurrences of blocks in their windows."""
    inside = np.zeros(len(a), bool)
    inside[(first[:, None] + np.arange(b)).ravel()] = True
    words, ranks = np.unique(a[inside], return_inverse=True)
    values = np.zeros(len(a) + 3 * b, np.uint64)  # 0: a word that no candidate block holds
    values[:len(a)][inside] = ranks + 1
    rest = np.flatnonzero(~inside)
    at = np.searchsorted(words, a[rest])
    at[at == len(words)] = 0
    values[rest] = np.where(words[at] == a[rest], at + 1, 0)
    found = []
    per = max(1, TILE // (2 * b))
    for offset in ((0, b) if b == BASE else (b,)):
        for i in range(0, len(first), per):
            some = first[i:i + per]
            blocks = values[some[None, :] + np.arange(b)[:, None]]
            windows = values[some[None, :] + offset + np.arange(2 * b - 1)[:, None]]
            shift, which = np.nonzero(_zeros(blocks, windows, len(words)))
            found.append(np.stack((some[which], shift + offset), axis=1))
    seeds = np.concatenate(found)
    return seeds[seeds[:, 1] > 0]


def _grow(a: np.ndarray, seeds: np.ndarray, b: int, least: int, runs: dict[tuple[int, int], int]) -> None:
    """Extends seeds to maximal stretches and keeps those that are runs, under their smallest period."""
    if not len(seeds):
        return
    seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
    place, dist = seeds[:, 0], seeds[:, 1]
    # neighbouring blocks at one distance are one stretch
    new = np.ones(len(seeds), bool)
    new[1:] = (dist[1:] != dist[:-1]) | (place[1:] != place[:-1] + b)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(seeds)) - 1
    d, lo, hi = dist[head], place[head], place[last] + b
    lo = lo - _extend(a, lo, d, -1)
    hi = hi + _extend(a, hi, d, 1)
    length = hi + d - lo
    keep = length >= np.maximum(least, TIMES * d)
    for s, m, q in zip(lo[keep].tolist(), length[keep].tolist(), d[keep].tolist()):  # ascending distances
        runs.setdefault((s, m), q)


def _kept(words: list[bytes], runs: list[list[int]]) -> list[bytes]:
    """The words outside of runs, and the first period of each."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, m, q in runs:
        gone[s + q] += 1
        gone[s + m] -= 1
    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
    return [words[i] for i in stay]


def scan(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[list[bytes], list[list[int]]]]:
    """(words, runs as [start, length, period]) of each text."""
    split = [t.split() for t in texts]  # bytes split at ASCII white space only
    sizes = np.array([len(w) for w in split], np.int64)
    known: dict[bytes, int] = {}
    a = np.empty(int(sizes.sum()) + len(split) + 1, np.int64)
    starts = np.zeros(len(split), np.int64)
    at = 0
    for k, words in enumerate(split):
        a[at] = -1 - k  # a number of its own before each text
        starts[k] = at + 1
        a[at + 1:at + 1 + len(words)] = [known.setdefault(w, len(known)) for w in words]
        at += 1 + len(words)
    a[at] = -1 - len(split)
    order = np.argsort(a, kind="stable")
    returns = np.full(len(a), np.iinfo(np.int64).max, np.int64)
    same = a[order[1:]] == a[order[:-1]]
    returns[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs = find(a, returns, int(sizes.max(initial=0)), least)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(split) + 1))
    for k, words in enumerate(split):
        own = runs[cuts[k]:cuts[k + 1]] - [starts[k], 0, 0]
        yield words, own.tolist()


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a batch, in slices of about ``SLICE`` bytes."""
    first, texts, held = 0, [], 0
    for i, t in enumerate(batch.column("text")):
        raw = t.as_buffer().to_pybytes()
        if texts and held + len(raw) > SLICE:
            yield first, texts
            first, texts, held = i, [], 0
        texts.append(raw)
        held += len(raw)
    if texts:
        yield first, texts


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def runs(docs: DataFrame, text: str = "text", doc: str = "doc_id", least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period, by start, then
    period), collapsed (the text's words without those that any run repeats, joined by a space)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc")
            for first, texts in _slices(batch):
                n_words, found, kept = [], [], []
                for words, own in scan(texts, least):
                    n_words.append(len(words))
                    found.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                    kept.append(b" ".join(_kept(words, own) if own else words).decode())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), pa.array(n_words, pa.int64()), pa.array(found, kind),
                     pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = pick(prepare(docs), doc=docs[doc].cast("long"), text=text_of(docs, text).cast("binary"))
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def report(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent, and digests, from the rows of ``runs``."""
    def higher(x: Column, y: Column) -> Column:
        """Greater exact length / period, then smaller start, then smaller period; ``x`` may be null."""
        left, right = y["length"] * x["period"], x["length"] * y["period"]
        wins = (left > right) | ((left == right) & ((y["start"] < x["start"]) | (
            (y["start"] == x["start"]) & (y["period"] < x["period"]))))
        return F.when(x.isNull() | wins, y).otherwise(x)

    best = F.aggregate("runs", F.lit(None).cast(RUN), higher)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")


def with_tails(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc_id and text, where a tenth of the documents gets a periodic tail (the contract's rule):
    with h = crc32(decimal id), g = h div 10, n words: if 10 divides h, each word i >= a = g % n
    becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).  A null id gets no tail."""
    ids, body = docs[doc].cast("long"), text_of(docs, text)
    h = F.crc32(ids.cast("string").cast("binary"))
    rows = pick(docs, doc_id=ids, text=body, h=h)
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    g, n = F.expr("h div 10"), F.size("words")
    rows = rows.withColumn("n", n).withColumn("g", g)
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("concat(slice(words, 1, int(a)), transform(sequence(int(a), n - 1), "
                  "i -> words[int(a + (i - a) % p)]))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))

