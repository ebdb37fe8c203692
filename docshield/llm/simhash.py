"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: ASCII-lower-cased words, shingles of three words, XXH64 (seed 42) of each, and a bit
per position that is set in over half of the hashes.  They are computed once, in Arrow batches,
and checkpointed as (id, text hash, fingerprint); the search below works on *distinct* fingerprints.

Search (distance <= ``most``, written t):

* The 64 bits are dealt to ``parts`` partitions, correlated bits to the same one, so that the
  other partitions stay selective.  Correlations come from one aggregate of bit co-occurrences
  (64 x 64 counts, whatever the input).
* Thresholds t_i >= -1 with sum t - parts + 1 are chosen by dynamic programming on the candidate
  counts estimated for each partition and threshold.  If every partition differed by more than its
  t_i, the distance would exceed t; so each linked pair meets in a partition with t_i >= 0.
* A fingerprint is indexed under its value in each used partition and probes all values within t_i.
  Within a meeting place the other bits still differ by at most t: they are cut in t + 1 pieces of
  which one must be equal, which makes the key longer.  Meeting places of over ``crowd``
  fingerprints are cut again in the same way until they are small or the bits are used up, so a
  crowded place is refined exactly instead of being capped.
* Pairs that meet are verified on the full fingerprints and merged into components.

Defined results: null text counts as empty; texts without words have fingerprint zero and are
linked like any other; a null id is never a component's id unless all ids of it are null; repeated
rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, cut_lineage, joined, pack, pick, prepare, text_of
from .graph import components
from .textblocks import word_blocks

SHINGLE = 3
MOST = 2
SEED = 42
PARTS = 3
CROWD = 64
#: Hashes turned into bits at a time; bounds the memory of a very long text.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    ones, total = np.zeros(64, np.int64), 0
    tail: list[bytes] = []
    for words in word_blocks(text.lower()):  # bytes: lower-cases A-Z only, parts at ASCII white space only
        words = tail + words
        if len(words) >= shingle:
            total += _add(words, shingle, seed, ones)
            tail = words[len(words) - shingle + 1:]
        else:
            tail = words
    if not total and tail:
        total = _add(tail, len(tail), seed, ones)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def _add(words: list[bytes], width: int, seed: int, ones: np.ndarray) -> int:
    """Add the bits of all shingles of a word list to ``ones``; their number."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[width - 1:].tolist())
    while block := list(itertools.islice(spans, BLOCK)):
        h = np.array([digest(line[a:b], seed) for a, b in block], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return last


def fingerprints(rows: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Replaces ``text`` by ``fp`` (bigint) in a table of internal columns."""
    keep = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(fps, pa.int64())], [*names, "fp"])

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def deal_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Greedy: a bit goes to the open partition whose bits it correlates with most."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    room = [64 // parts + (i < 64 % parts) for i in range(parts)]
    made: list[list[int]] = [[] for _ in range(parts)]
    order = [int(i) for i in np.argsort(-corr.sum(1), kind="stable")]
    for bit in order:
        open_parts = [i for i in range(parts) if len(made[i]) < room[i]]
        best = max(open_parts, key=lambda i: (corr[bit, made[i]].mean() if made[i] else 0.0, -len(made[i]), -i))
        made[best].append(bit)
    return [sorted(m) for m in made]


def thresholds(cost: list[list[float]], total: int) -> list[int]:
    """t_i in -1..len(cost[i])-2 with the given sum and the least sum of cost[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in enumerate(row, -1):
                if s + t not in nxt or c + more < nxt[s + t][0]:
                    nxt[s + t] = (c + more, [*chosen, t])
        best = nxt
    return best[total][1]


def _take(fp: Column, bits: list[int]) -> Column:
    """The named bits of ``fp``, others cleared (a mask, so no value is ever re-packed)."""
    return fp.bitwiseAND(F.lit(_mask(bits)))


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _flips(bits: list[int], most: int) -> list[int]:
    return [_mask(list(c)) for k in range(most + 1) for c in itertools.combinations(bits, k)]


def _statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and 64 x 64 counts of bits set together: sums of bit rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column("fp")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += (bits.astype(np.float32).T @ bits.astype(np.float32)).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(4097), pa.int32()), pa.array(np.append(total.ravel(), n), pa.int64())], ["cell", "n"])

    rows = fps.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(4097, np.int64)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def choose(fps: DataFrame, most: int = MOST, parts: int = PARTS) -> tuple[list[list[int]], list[int]]:
    """Partitions and their thresholds.  The candidate count of partition i at threshold t is
    estimated as (pairs with equal value) x (share of probes within t, as for independent bits),
    plus the probes themselves."""
    n, counts = _statistics(fps)
    dealt = deal_bits(counts, n, parts)
    values = fps.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _take(F.col("fp"), bits).alias("v")) for i, bits in enumerate(dealt)])).alias("x"))
    same = values.groupBy("x.i", "x.v").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("i").agg(
        F.sum(F.col("c") * F.col("c")).alias("pairs")).collect()  # one row a partition
    pairs = {r["i"]: r["pairs"] for r in same}
    cost = [[0.0, *[(pairs.get(i, 0.0) + n) * sum(comb(len(bits), k) for k in range(t + 1)) for t in range(most + 1)]]
            for i, bits in enumerate(dealt)]
    return dealt, thresholds(cost, most - parts + 1)


def _split(bits: list[int], pieces: int) -> list[list[int]]:
    return [bits[k::pieces] for k in range(pieces)]


def _refine(rows: DataFrame, layer: dict[int, list[int]], most: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """Each meeting place (place, key) is cut in most + 1 by pieces of the bits still free."""
    pieces = {place: _split(free, most + 1) for place, free in layer.items()}
    new = {place * (most + 1) + k: [b for b in layer[place] if b not in piece]
           for place, cut in pieces.items() for k, piece in enumerate(cut)}
    table = [[_mask(piece) for piece in pieces.get(place, [])] for place in range(max(pieces) + 1)]
    masks = F.get(F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>"), F.col("place").cast("int"))
    cut = F.transform(masks, lambda mask, k: F.struct(
        (F.col("place") * (most + 1) + k).alias("place"), F.xxhash64(F.col("key"), F.col("fp").bitwiseAND(mask)).alias("key")))
    return rows.withColumn("o", F.explode(cut)).select("o.place", "o.key", "fp", "probe"), new


def links(fps: DataFrame, most: int = MOST, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints at distance <= most."""
    dealt, limit = choose(fps, most, parts)
    index, layer = [], {}
    for i, (bits, t) in enumerate(zip(dealt, limit)):
        if t < 0:
            continue
        layer[i] = [b for b in range(64) if b not in bits]
        for probe, flips in ((False, [0]), (True, _flips(bits, t) if t else [])):
            index += [F.struct(F.lit(i).cast("long").alias("place"), F.lit(probe).alias("probe"),
                               F.xxhash64(F.lit(i), _take(F.col("fp"), bits).bitwiseXOR(F.lit(x))).alias("key"))
                      for x in flips if not (probe and x == 0)]
    rows = fps.withColumn("o", F.explode(F.array(*index))).select("o.place", "o.key", "fp", "o.probe")
    rows, layer = _refine(rows, layer, most)
    found = []
    while True:
        many = rows.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"))
        crowded = many.filter(F.col("n") > crowd).select("place", "key")
        free = max(map(len, layer.values()))
        last = free <= most + 1 or crowded.isEmpty()
        some = rows if last else rows.join(crowded, ["place", "key"], "left_anti")
        a = some.select("place", "key", F.col("fp").alias("a"), F.col("probe").alias("p"))
        b = some.filter("not probe").select("place", "key", F.col("fp").alias("b"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
        order = (F.col("a") < F.col("b")) | (F.col("p") & (F.col("a") != F.col("b")))
        found.append(a.join(b, ["place", "key"]).filter(near & order).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        if last:
            break
        rows, layer = _refine(rows.join(crowded, ["place", "key"], "left_semi"), layer, most)
        rows = cut_lineage(rows)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _smallest() -> Column:
    return F.min(F.struct(F.col("doc").isNull().alias("unnamed"), F.col("doc"), F.col("th")))


def classes(rows: DataFrame, most: int = MOST, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """(fp, best) for each distinct fingerprint of a (doc, th, fp) table: ``best`` is the
    (unnamed, doc, th) of its component's smallest document."""
    each = cut_lineage(rows.groupBy("fp").agg(_smallest().alias("first")))
    found = components(links(each.select("fp"), most, parts, crowd))
    each = each.join(found, each["fp"] == found["vertex"], "left").withColumn("root", F.coalesce("root", "fp"))
    best = each.groupBy("root").agg(F.min("first").alias("best"))
    return each.select("fp", "root").join(best, "root").select("fp", "best")


def _key(docs: DataFrame, text: str, doc: str) -> dict[str, Column]:
    """What names a row: its id and a hash of its text (ids may repeat or be null)."""
    return {"doc": docs[doc].cast("long"), "th": F.xxhash64(text_of(docs, text))}


def _table(docs: DataFrame, text: str, doc: str, shingle: int) -> DataFrame:
    rows = pick(prepare(docs), **_key(docs, text, doc), text=text_of(docs, text))
    return cut_lineage(fingerprints(rows, shingle))


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE,
                    most: int = MOST, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = _table(docs, text, doc, shingle)
    out = joined(rows, classes(rows, most, parts, crowd), ["fp"], "inner")
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("best.doc").alias("component_id"))


def representatives(docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE,
                    most: int = MOST, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """One document of each component stays, that with the smallest id (columns as given)."""
    best = classes(_table(docs, text, doc, shingle), most, parts, crowd).select("best.doc", "best.th").distinct()
    keys = ["doc", "th"]
    return joined(pack(docs, **_key(docs, text, doc)), best, keys, "inner").dropDuplicates(keys).select(f"{ROW}.*")
