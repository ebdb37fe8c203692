"""Policies as tables (G1, G3, G4, G7, G8): a pattern index joined to the texts.

A policy of any size stays a table; no task and no driver holds its patterns.  A text that a pattern
matches, as a word or as a substring, holds each run of ``GRAM`` characters of the pattern (of a
shorter pattern: the pattern itself).  So:

1. the runs of all patterns are counted in the distinct texts;
2. a pattern that has a run which no text holds is out; each other is indexed under its run that the
   fewest texts hold, its anchor;
3. the texts' anchors are joined with the index, and each pair found is checked by the rule of G1;
4. of the patterns that hold, the first in the list of the text's tier is its rule.

Runs travel as 64-bit hashes; two runs with one hash only make a pair more to check.  A bitmap of
2**22 bits tells each task which runs of its texts to send on; its size is fixed, and with a policy so
large that all bits are set it saves nothing and changes nothing.  Equal texts are looked at once.

Defined results: null and empty texts have no rule; patterns that are null or blank match nothing; a
tier that the policy does not know, or null, uses the fallback tier's patterns (the built-in ones if
the policy has none); of patterns with equal ``ord`` the smaller text comes first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield.functions import guard as G
from docshield.operators.sizing import broadcast_if_small
from docshield.session import ensure_checkpoint_dir

#: Characters of a run.
GRAM = 4
#: The bitmap has 2**BITS bits.
BITS = 22
#: Tiers up to this number are broadcast to the rows that name them.
TIERS = 100_000
#: White space, and the four separators that count as such in Python only.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


@dataclass
class PolicyTables:
    """``patterns`` (tier, direction, ord, pattern) and ``tiers`` (tier, ...), as G8 stores them.  Takes
    the place of a ``Policy`` in the guard operators."""

    patterns: DataFrame
    tiers: DataFrame

    def known(self) -> DataFrame:
        return self.patterns.select("tier").unionByName(self.tiers.select("tier")).distinct()

    def cleaned(self, direction: str) -> DataFrame:
        """tier, ord, pattern, clean of one direction, without patterns that match nothing."""
        rows = self.patterns.filter(F.col("direction") == direction).select("tier", "ord", "pattern")
        if self.known().filter(F.col("tier") == G.FALLBACK_TIER).isEmpty():
            own = G.Policy.default().patterns(G.FALLBACK_TIER, direction)
            made = rows.sparkSession.createDataFrame([(G.FALLBACK_TIER, i, p) for i, p in enumerate(own)], "tier string, ord int, pattern string")
            rows = rows.unionByName(made)
        return rows.withColumn("clean", F.lower(F.regexp_replace("pattern", EDGES, ""))).filter(F.col("clean") != "")


def load_policy_tables(spark: SparkSession, path: str) -> PolicyTables:
    """G8 as tables: the stored policy without collecting it; the default where there is none."""
    from docshield.operators.guarding import policy_rows, tiers_frame
    from docshield.sources.stores import read_if_there
    patterns, tiers = read_if_there(spark, f"{path}/patterns"), read_if_there(spark, f"{path}/tiers")
    if patterns is None or tiers is None or tiers.isEmpty():
        return PolicyTables(policy_rows(spark), tiers_frame(spark))
    return PolicyTables(patterns, tiers)


# ------------------------------------------------------------------------------- runs
def run_hashes(text: str, length: int) -> np.ndarray:
    """Hash of every run of ``length`` characters of a text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < length:
        return code[:0]
    h = np.full(len(code) - length + 1, length, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[i:len(code) - length + 1 + i]
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pattern_runs(text: str) -> np.ndarray:
    return np.unique(run_hashes(text, min(GRAM, len(text))))


def _flags(runs: DataFrame) -> np.ndarray:
    """The bitmap of the column ``h``; at most 2**(BITS - 6) words come to the driver."""
    bit = F.shiftrightunsigned("h", 64 - BITS)
    words = (runs.groupBy(F.shiftrightunsigned("h", 64 - BITS + 6).alias("at"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("word")))
    made = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.collect():
        made[r["at"]] = r["word"]
    return made


def _selected(text: str, flags: np.ndarray) -> np.ndarray:
    """Distinct hashes of the text's runs whose bit is set, signed."""
    kept = []
    for n in range(1, GRAM + 1):
        h = run_hashes(text, n)
        at = h >> np.uint64(64 - BITS)
        kept.append(h[(flags[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1 == 1])
    return np.unique(np.concatenate(kept)).view(np.int64)


def _pattern_table(patterns: DataFrame) -> DataFrame:
    """tier, clean, ord, pattern, h: a row for each run of each different pattern of a tier (after
    cleaning), with the first place and form in which the tier lists it."""
    kind = patterns.schema["ord"].dataType.simpleString()
    first = patterns.groupBy("tier", "clean").agg(F.min(F.struct("ord", "pattern")).alias("first")).select("tier", "clean", "first.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [pattern_runs(p).view(np.int64) for p in batch.column("clean").to_pylist()]
            take = pa.array(np.repeat(np.arange(len(runs)), [len(r) for r in runs]))
            h = np.concatenate(runs) if runs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("tier", "ord", "pattern", "clean")], pa.array(h)],
                                             ["tier", "ord", "pattern", "clean", "h"])

    return first.select("tier", "ord", "pattern", "clean").mapInArrow(run, f"tier string, ord {kind}, pattern string, clean string, h long")


def _run_counts(texts: DataFrame, flags: np.ndarray) -> DataFrame:
    """h, n: in how many texts a run stands, for the flagged runs; summed by batch first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_selected(t, flags) for t in batch.column("low").to_pylist()]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    return texts.select("low").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _text_runs(texts: DataFrame, flags: np.ndarray) -> DataFrame:
    """tier, sha, h: the flagged runs of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("low").to_pylist()):
                h = _selected(t, flags)
                take = pa.array(np.full(len(h), i))
                yield pa.RecordBatch.from_arrays([batch.column("tier").take(take), batch.column("sha").take(take), pa.array(h)], ["tier", "sha", "h"])

    return texts.select("tier", "sha", "low").mapInArrow(run, "tier string, sha binary, h long")


def _holds(low: Column, clean: Column) -> Column:
    """The rule of G1 on a lower-cased text and a cleaned pattern."""
    return F.when(F.regexp_like(clean, F.lit("^[a-z]+$")), F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), clean, F.lit(r"s?\b")))) \
            .otherwise(F.instr(low, clean) > 0)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/policy/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------------------- operators
def keyed(df: DataFrame, text: str, tier: str, policy: PolicyTables) -> DataFrame:
    """Adds ``_tier`` (the tier whose patterns count) and ``_sha`` (of the lower-cased text)."""
    known = policy.known().select(F.col("tier").alias("_tier"))
    rows = df.select("*", F.lower(F.col(text)).alias("_low"), F.col(tier).alias("_named"))
    joined = rows.join(broadcast_if_small(known, TIERS), F.col("_named") == F.col("_tier"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "_low", F.coalesce("_tier", F.lit(G.FALLBACK_TIER)).alias("_tier"),
                         F.unhex(F.sha2(F.col("_low").cast("binary"), 256)).alias("_sha"))


def hits(rows: DataFrame, policy: PolicyTables, direction: str) -> DataFrame:
    """tier, sha, clean, ord, pattern: every different pattern that a text of ``keyed`` rows holds, once a
    distinct text, with the first place and form in which the tier lists it."""
    patterns = policy.cleaned(direction)
    texts = _stored(rows.filter("_low <> ''").select(F.col("_tier").alias("tier"), F.col("_sha").alias("sha"), F.col("_low").alias("low"))
                    .dropDuplicates(["tier", "sha"]), "texts")
    runs = _stored(_pattern_table(patterns), "runs")
    counts = _run_counts(texts, _flags(runs))
    listed = runs.join(counts, "h", "left")
    index = _stored(listed.groupBy("tier", "ord", "pattern", "clean")
                    .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("anchor"))
                    .filter(F.col("anchor.n") > 0).select("tier", "ord", "pattern", "clean", F.col("anchor.h").alias("h")), "index")
    found = _text_runs(texts, _flags(index)).join(index, ["tier", "h"]).drop("h")
    return found.join(texts, ["tier", "sha"]).filter(_holds(F.col("low"), F.col("clean"))).select("tier", "sha", "clean", "ord", "pattern")


def with_rule(df: DataFrame, text: str, tier: str, policy: PolicyTables, direction: str, out: str = "rule") -> DataFrame:
    """G1 over tables: adds ``out``, the first pattern of the row's tier that its text holds, as stored."""
    rows = keyed(df, text, tier, policy)
    first = hits(rows, policy, direction).groupBy(F.col("tier").alias("_tier"), F.col("sha").alias("_sha")) \
        .agg(F.min(F.struct("ord", "pattern"))["pattern"].alias("_rule"))
    return rows.join(first, ["_tier", "_sha"], "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col("_rule").alias(out))


def violations(df: DataFrame, text: str, tier: str, policy: PolicyTables, direction: str = "in", keep: list[str] | None = None) -> DataFrame:
    """G7 over tables: one row for each row and tier pattern that it holds (``ord``, ``pattern``)."""
    rows = keyed(df, text, tier, policy)
    listed = policy.cleaned(direction).select("tier", "clean", F.col("ord").alias("_ord"), F.col("pattern").alias("_pattern"))
    # written before the join, so that no pair is checked once for each place of its pattern
    every = _stored(hits(rows, policy, direction).select("tier", "sha", "clean"), "hits").join(listed, ["tier", "clean"]) \
        .select(F.col("tier").alias("_tier"), F.col("sha").alias("_sha"), "_ord", "_pattern")
    found = rows.join(every, ["_tier", "_sha"])
    return found.select(*[F.col(f"`{c}`") for c in (keep or df.columns)], F.col("_ord").alias("ord"), F.col("_pattern").alias("pattern"))
