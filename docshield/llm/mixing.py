"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every document gets a rate in [0, ``cap``] that stays as close as possible, in bounded (Fermi)
entropy, to one copy, while the rates of a source must give its target in words.  The dual of
that convex problem has one unknown per source: the rate of a document of ``size`` words is
``cap * e / (cap - 1 + e)`` with ``e = exp(tilt * size / scale)``, an exponential tilt of the odds.

* The dual is solved by Newton iterations, all sources at once, each a Spark aggregate over the
  histogram (source, size, count).  The histogram is a sufficient statistic: it grows with the
  distinct sizes, not with the documents, so a hot source is no hot key.  A bracket per source
  replaces a Newton step that leaves it by its middle, so the iteration always converges.
* Rates become whole copies by rounding the running total of expected copies over sizes in
  falling order.  The error in words telescopes to less than half the largest size of the source,
  and one cell near the rest is then corrected by a copy.
* Inside a (source, size) cell the copies go to the first documents by (hash of id, id).  The cut
  is found by an exact selection over ``parts`` hash ranges per cell, so a cell that holds a third
  of all rows is never ranked in one task.

Defined results: null text has size 0; a document of size 0 is in a cell like any other; null
source is a source of its own, last in order; rows with equal id, source and size are treated
alike; a source of size 0 has target 0; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WORD, cut_lineage, joined, pack, pick, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
PARTS = 1024
STEPS = 60


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def histogram(sized: DataFrame) -> DataFrame:
    """source, size, n of a (source, size, ...) table."""
    return sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))


def targets(hist: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target.  Sources are ranked by code point, null last; their weights
    repeat.  Water-filling: sorted by how soon a source meets its cap, the capped ones are a
    prefix, so running sums over the source table give the result in one pass."""
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(table, F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")))
    every = Window.partitionBy()
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), F.col("rank"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
           .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
           .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
           .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the water level a source would see if all sources before it were capped
    per = per.withColumn("level", F.greatest(F.col("total") - F.col("spent"), F.lit(0.0)) / F.col("left"))
    per = per.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)
    return per.select("source", F.col("source_size").cast("long"),
                      F.when(F.col("full"), F.col("limit")).otherwise(level["level"] * F.col("weight")).alias("target"))


def _rate(tilt: Column, size: Column, scale: Column, cap: float) -> Column:
    x = F.least(F.greatest(tilt * size / scale, F.lit(-700.0)), F.lit(700.0))
    e = F.exp(x)
    return F.lit(cap) * e / (F.lit(cap - 1.0) + e)


def solve(hist: DataFrame, goals: DataFrame, cap: float = CAP, steps: int = STEPS, tolerance: float = 1e-7) -> DataFrame:
    """The tilt of each source, by safeguarded Newton iterations on the dual.  Sources whose
    target is nothing or all their copies need no tilt and are left out (tilt null)."""
    goals = cut_lineage(goals)
    inner = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap))
    state = goals.filter(inner).select(
        "source", "target", "source_size",
        F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    scale = hist.groupBy("source").agg(F.greatest(F.avg("size"), F.lit(1.0)).alias("scale"))
    state = cut_lineage(joined(state, scale, ["source"], "inner"))
    for _ in range(steps):
        rows = joined(hist, state, ["source"], "inner")
        rows = rows.withColumn("rate", _rate(F.col("tilt"), F.col("size"), F.col("scale"), cap))
        mass = F.col("n") * F.col("size")
        sums = rows.groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("target", "source_size", "tilt", "low", "high", "scale")],
            F.sum(mass * F.col("rate")).alias("got"),
            F.sum(mass * F.col("size") / F.col("scale") * F.col("rate") * (1 - F.col("rate") / F.lit(cap))).alias("slope"))
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        moved = sums.withColumn("gap", gap).withColumn("low", low).withColumn("high", high)
        newton = F.col("tilt") - F.col("gap") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        # a bracket that is still open grows from the present tilt before it is halved
        open_high, open_low = F.col("high") >= 1e6, F.col("low") <= -1e6
        middle = (F.when(open_high, F.greatest(F.col("low") * 2, F.lit(1.0)))
                  .when(open_low, F.least(F.col("high") * 2, F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2))
        middle = F.least(F.greatest(middle, F.lit(-1e6)), F.lit(1e6))
        close = F.abs(F.col("gap")) <= F.lit(tolerance) * F.greatest(F.col("source_size"), F.lit(1))
        # all copies (or none): the tilt only has to be far out
        done = close | (F.col("tilt") >= 1e5) | (F.col("tilt") <= -1e5)
        state = cut_lineage(moved.select(
            "source", "target", "source_size", "scale", "low", "high", done.alias("done"),
            F.when(done, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt")))
        if state.filter(~F.col("done")).isEmpty():
            break
    return joined(goals, state.select("source", "tilt", "scale"), ["source"], "left")


def cells(hist: DataFrame, solved: DataFrame, cap: float = CAP) -> DataFrame:
    """source, size, n, source_size, target, copies: whole copies of each histogram cell."""
    rows = joined(hist, solved, ["source"], "inner")
    rows = rows.withColumn("rate", F.when(F.col("target") <= 0, F.lit(0.0))
                           .when(F.col("target") >= F.col("source_size") * F.lit(cap), F.lit(float(cap)))
                           .otherwise(_rate(F.col("tilt"), F.col("size"), F.col("scale"), cap)))
    falling = Window.partitionBy("source").orderBy(F.col("size").desc())
    run = F.sum(F.col("rate") * F.col("n")).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", F.round(run, 0).cast("long"))
    rows = rows.withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(falling), F.lit(0)))
    most = (F.col("n") * F.lit(int(cap))).cast("long")
    rows = rows.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), most))
    # one copy more or less of the cell whose size is nearest to what is missing
    whole = Window.partitionBy("source")
    rest = F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)).cast("long")
    rows = rows.withColumn("rest", rest)
    step = F.when((F.col("rest") > 0) & (F.col("copies") < most), 1).when((F.col("rest") < 0) & (F.col("copies") > 0), -1)
    off = F.abs(F.abs(F.col("rest")) - F.col("size"))
    useful = step.isNotNull() & (F.col("size") > 0) & (off < F.abs(F.col("rest")))
    rows = rows.withColumn("fit", F.when(useful, F.struct(off, F.col("size"))))
    chosen = F.col("fit").isNotNull() & (F.col("fit") == F.min("fit").over(whole))
    return rows.select("source", "size", "n", "source_size", "target",
                       (F.col("copies") + F.when(chosen, step).otherwise(0)).alias("copies"))


def _order() -> Column:
    return F.struct(F.xxhash64("doc").alias("h"), F.col("doc").alias("doc"))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, parts: int = PARTS) -> DataFrame:
    """One row per (source, size) cell: source_size, target, base (copies of every document)
    and cut (documents ordered up to it get one more; null: none, as extra is 0)."""
    hist = cut_lineage(histogram(sized))
    made = cells(hist, solve(hist, targets(hist, weights, share, cap), cap), cap)
    made = made.withColumn("base", F.floor(F.col("copies") / F.col("n")).cast("long"))
    made = cut_lineage(made.withColumn("extra", F.col("copies") - F.col("base") * F.col("n")))
    need = made.filter("extra > 0").select("source", "size", "extra")
    part = F.shiftrightunsigned(F.xxhash64("doc").bitwiseXOR(F.lit(-(1 << 63))), 64 - (parts.bit_length() - 1)).cast("int")
    keyed = sized.select("source", "size", "doc", part.alias("part"))
    per_part = keyed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    per_part = joined(per_part, need, ["source", "size"], "inner")
    upto = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (per_part.withColumn("through", F.sum("m").over(upto))
                .filter("through >= extra and through - m < extra")
                .select("source", "size", "part", (F.col("extra") - (F.col("through") - F.col("m"))).alias("nth")))
    inside = joined(keyed, crossing, ["source", "size", "part"], "inner").withColumn("key", _order())
    nth = Window.partitionBy("source", "size", "part").orderBy("key")
    cuts = inside.withColumn("i", F.row_number().over(nth)).filter("i = nth").select("source", "size", F.col("key").alias("cut"))
    # written, so that the join with the documents has two plain shuffles and a hot cell is split
    return cut_lineage(joined(made, cuts, ["source", "size"], "left")
                       .select("source", "size", "source_size", "target", "base", "cut"))


def _mixed(rows: DataFrame, planned: DataFrame) -> DataFrame:
    out = joined(rows, planned, ["source", "size"], "inner")
    more = F.col("cut").isNotNull() & (_order() <= F.col("cut"))
    return out.withColumn("copies", F.col("base") + more.cast("long"))


def _sized(docs: DataFrame, text: str, doc: str, source: str, make=pick) -> DataFrame:
    return make(docs, doc=docs[doc].cast("long"), source=docs[source].cast("string"), size=words(text_of(docs, text)))


def mix(docs: DataFrame, text: str = "text", doc: str = "doc_id", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, cap: float = CAP, parts: int = PARTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    rows = cut_lineage(_sized(docs, text, doc, source))
    out = _mixed(rows, plan(rows, weights, share, cap, parts))
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def copies(docs: DataFrame, text: str = "text", doc: str = "doc_id", source: str = "source", weights=WEIGHTS,
           share: float = SHARE, cap: float = CAP, parts: int = PARTS) -> DataFrame:
    """The mixed documents: each input row as often as the mix takes it (columns as given)."""
    planned = plan(cut_lineage(_sized(docs, text, doc, source)), weights, share, cap, parts)
    out = _mixed(_sized(docs, text, doc, source, pack), planned).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(f"{ROW}.*")
