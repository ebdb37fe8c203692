"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction, 2 ** -``LEVEL``, of the hash range.
A text with fewer than ``LEAST`` hashes below that keeps those below the next larger power of a half
that gives it as many, at most all of them, so a short text is sketched whole.  A sketch carries its
level and two sketches are compared at the coarser of their levels, where each is the full set of its
text's hashes below one limit: the sketch of a union is there the union of the sketches, and the
share of a small document's hashes that a large one also has estimates its containment without bias,
however unequal the two are.  With n hashes of the smaller text below the common limit the standard
error is sqrt(p (1 - p) / n), at most 1 / (2 sqrt(n)): 0.07 for texts of like length (n >= ``LEAST``),
0.014 for 20,000 words, and 0 where both texts are sketched whole.  A short text whose hashes
all lie above a long one's limit gives no evidence and counts as not contained.  Shingles are five
words, ASCII-lower-cased; a text of fewer words is one shingle.

``neighbours`` compares each document with the next one and with an edited text whose end is the
next one's beginning.  Documents are dealt to ranges of ids (split points from one aggregate over
the id column), sorted within tasks and read as a stream, so a task holds two texts at a time.  The
first row of a range is also sent to the range before it: one extra row per range.

Defined results: null text counts as empty, with an empty fingerprint; two empty fingerprints have
likeness 1, an empty one and another 0; null ids come after all others, ordered like rows of equal
id by a hash of their text; very long texts are sketched whole, a block at a time; extra columns of
any name are ignored; one document is its own next; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare, text_of
from .textblocks import word_blocks

SHINGLE = 5
#: The fixed fraction is 2 ** -LEVEL; the fewest hashes of a sketch that is not of the whole text.
LEVEL = 4
LEAST = 48
#: Word hashes kept per worker.
KEPT = 500_000
#: Output rows gathered at a time.
ROWS = 256
#: Hash digits shown (hexadecimal); equal prefixes of different hashes are as rare as 2 ** -48.
DIGITS = 12

_WORDS: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = _WORDS
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > KEPT:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word (public splitmix constants)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Sketch(NamedTuple):
    """The sorted hashes of a text below 2 ** (64 - level)."""

    hashes: np.ndarray
    level: int

    def at(self, level: int) -> np.ndarray:
        """The hashes below the limit of a level that is not finer."""
        return self.hashes if level == self.level else self.hashes[:np.searchsorted(self.hashes, _limit(level))]


def _limit(level: int) -> np.uint64:
    return np.uint64(1 << 64 - level) if level else np.uint64((1 << 64) - 1)


def sketch(raw: bytes, shingle: int = SHINGLE, level: int = LEVEL, least: int = LEAST) -> Sketch:
    """The hashes that a text keeps, at the coarsest level up to ``level`` that leaves ``least``."""
    now, kept = 0, np.empty(0, np.uint64)
    tail = np.empty(0, np.uint64)
    factors = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, shingle + 1)], np.uint64)
    seen = 0
    for words in word_blocks(raw.lower()):
        h = np.concatenate((tail, _word_hashes(words)))
        seen += len(words)
        n = len(h) - shingle + 1
        if n > 0:
            s = np.zeros(n, np.uint64)
            for k in range(shingle):
                s += h[k:k + n] * factors[k]
            s = _mix(s)
            kept = np.unique(np.concatenate((kept, s[s < _limit(now)] if now else s)))
            # a limit that leaves enough hashes stays so, whatever comes later
            while now < level and np.searchsorted(kept, _limit(now + 1)) >= least:
                now += 1
                kept = kept[:np.searchsorted(kept, _limit(now))]
        tail = h[max(0, len(h) - shingle + 1):]
    if 0 < seen < shingle:
        kept = _mix((tail * factors[:len(tail)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(tail)))
    return Sketch(kept, now)


def union(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles, at the coarser level."""
    level = max(a.level, b.level)
    return Sketch(np.union1d(a.at(level), b.at(level)), level)


def shown(s: Sketch) -> str:
    """A sketch as text: its level, then fixed-width hexadecimal hashes in ascending order; empty
    without words."""
    digits = "".join(map(f"%0{DIGITS}x".__mod__, (s.hashes >> np.uint64(64 - 4 * DIGITS)).tolist()))
    return f"{s.level:x}{digits}" if digits else ""


def _common(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Hashes of each, and of both, below the common limit."""
    level = max(a.level, b.level)
    x, y = a.at(level), b.at(level)
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the smaller text's shingles that the other also has."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    x, y, both = _common(a, b)
    return both / max(min(x, y), 1)


def jaccard(a: Sketch, b: Sketch) -> float:
    """Estimated share of all shingles of both texts that both have."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    x, y, both = _common(a, b)
    return both / max(x + y - both, 1)


def sketches(docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE,
             level: int = LEVEL, least: int = LEAST) -> DataFrame:
    """doc_id, level, hashes (array of bigint, read as unsigned): sketches to merge or compare later."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t.as_buffer().to_pybytes(), shingle, level, least) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([m.level for m in made], pa.int32()),
                 pa.array([m.hashes.view(np.int64) for m in made], pa.list_(pa.int64()))], ["doc_id", "level", "hashes"])

    rows = pick(prepare(docs), doc=docs[doc].cast("long"), text=text_of(docs, text).cast("binary"))
    return rows.mapInArrow(run, "doc_id bigint, level int, hashes array<bigint>")


def _ranges(keys: DataFrame, parts: int) -> np.ndarray:
    """Split points of the id column: at most ``parts`` - 1 numbers."""
    shares = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx("doc", shares or [0.5], 20_000).alias("p")).first()["p"] if parts > 1 else None
    return np.unique(np.array(found or [], np.int64))


def _dealt(docs: DataFrame, text: str, doc: str, parts: int) -> DataFrame:
    """Rows with their range, and the first row of each range once more for the range before it."""
    body = text_of(docs, text)
    rows = pick(docs, doc=docs[doc].cast("long"), th=F.xxhash64(body), text=body)
    cuts = _ranges(rows.select("doc"), parts)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, named: pd.Series, hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, ids.to_numpy(np.int64), side="right")
        unnamed = len(cuts) + 1 + (hashes.to_numpy(np.int64) >> 58) + 32  # 64 ranges of text hashes
        return pd.Series(np.where(named, at, unnamed).astype(np.int32))

    named = F.col("doc").isNotNull()
    key = F.struct(F.coalesce("doc", F.lit(0)).alias("doc"), F.col("th"))
    rows = rows.withColumn("part", range_of(F.coalesce("doc", F.lit(0)), named, "th")).withColumn("named", named)
    heads = rows.groupBy("part").agg(F.min(key).alias("head")).orderBy("part").collect()  # one row per range
    order = [r["part"] for r in heads]
    before = {p: order[i - 1] for i, p in enumerate(order)}
    first = {r["part"]: (r["head"]["doc"], r["head"]["th"]) for r in heads}

    @F.pandas_udf("int")
    def guest_of(part: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        out = np.full(len(part), -1, np.int32)
        for p in part.unique():
            d, h = first[p]
            out[((part == p) & (ids == d) & (hashes == h)).to_numpy()] = before[p]
        return pd.Series(out)

    rows = rows.withColumn("guest", guest_of("part", F.coalesce("doc", F.lit(0)), "th"))
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")),
                     F.struct(F.col("guest").alias("part"), F.lit(True).alias("extra")))
    rows = rows.withColumn("place", F.explode(F.filter(places, lambda x: x["part"] >= 0)))
    return rows.select(F.col("place.part").alias("part"), F.col("place.extra").alias("extra"), "named", "doc", "th", "text")


def neighbours(docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE,
               level: int = LEVEL, least: int = LEAST, parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (containment), and the Jaccard estimates of both pairs."""
    spark = prepare(docs).sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _dealt(docs, text, doc, 4 * parts)  # several ranges a task even out their sizes
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "extra", F.col("named").desc(), "doc", "th")
    fields = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
              "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
              "jaccard_edited": pa.float64(), "jaccard_next": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        last = None  # (part, doc, text, sketch) of the row before

        def rows_out() -> pa.RecordBatch:
            cols = [pa.array(list(c), t) for c, t in zip(zip(*made), fields.values())]
            made.clear()
            return pa.RecordBatch.from_arrays(cols, list(fields))

        for batch in batches:
            for part, extra, d, t in zip(*[batch.column(c) for c in ("part", "extra", "doc", "text")]):
                part, t = part.as_py(), t.as_py()
                own = sketch(t.encode(), shingle, level, least)
                if last and last[0] == part:
                    _, before, old, h = last
                    n = len(old)
                    edited = (old[:n - n // 4] + t[:n // 4]).encode()
                    e = sketch(edited, shingle, level, least)
                    made.append((before, n, hashlib.sha256(edited).hexdigest(), shown(h), shown(e),
                                 containment(h, e), containment(h, own), jaccard(h, e), jaccard(h, own)))
                    if len(made) >= ROWS:
                        yield rows_out()
                last = None if extra.as_py() else (part, d.as_py(), t, own)
        if made:
            yield rows_out()

    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, jaccard_edited double, jaccard_next double")
    return rows.select("part", "extra", "doc", "text").mapInArrow(run, schema)
