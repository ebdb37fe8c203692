"""Merkle manifest of a table with a proof for every row, by pointer jumping (DataFrame functions only).

Rows are leaves.  Inside a group they stand in order, and every ``FANOUT`` consecutive nodes become
one node, the digest of their digests, until one is left: the group's subroot.  The subroots, in
order of their groups, become the root in the same way.  Digests are SHA-256 in lower-case hex.

A proof lists, level by level, the siblings before and after the path's node (a segment).  Inner
nodes start with the segment towards their parent; each round joins the table with itself, so that
every node takes over its ancestor's ancestor and appends its segments, which doubles the distance,
until all have reached the root: a logarithm of the height in rounds.  Leaves enter the last join
by whole runs of siblings, which share everything above their parent, and are folded in place.

Scale: ranks come from range partitions (a group with a third of all rows spans many tasks), a
level is one aggregate keyed by group and run, and each ancestor is met by many nodes only in as
many salted copies as it has blocks of ``BLOCK`` leaves below it.  The text of a row is read once;
afterwards only digests move.  On the driver: the largest group's size and the number of groups.

Defined results: a null field is hashed as "-" and a null group comes before all others; null
order values come first; rows of equal order value stand in order of their digests (equal rows are
interchangeable); empty and very long texts are hashed whole; an empty table gives an empty table;
extra columns of any name are ignored; a group of one row has that leaf as its subroot, and a single
group's subroot is the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docshield.operators.ordinal import ordinal_in_groups

from .common import cut_lineage, pick

FANOUT = 16
#: Leaves below a salted copy of an ancestor.
BLOCK = 65_536
#: The tree over the groups' subroots; no group's key is this.
TOP = "^"
SEGMENTS = "array<struct<l:string,r:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field as it is hashed: its UTF-8 bytes counted and shown, or "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A group as a string that is never null and sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the rank from 0 in the group ``t``."""
    ranked = ordinal_in_groups(rows, ["t"], order, out="at", force_split=True)
    return ranked.withColumn("at", F.col("at") - 1)


def _runs(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Runs of siblings: t, run, kids (in order: at, h, n and carried columns), h and n of their parent."""
    kids = F.sort_array(F.collect_list(F.struct("at", "h", "n", *carry)))
    runs = nodes.groupBy("t", F.floor(F.col("at") / FANOUT).alias("run")).agg(kids.alias("kids"), F.sum("n").alias("n"))
    # a run 0 of one node has no other run beside it: that node is the last of its tree
    runs = runs.withColumn("last", (F.col("run") == 0) & (F.size("kids") == 1))
    return runs.withColumn("h", F.sha2(F.array_join("kids.h", ""), 256))


def _kids(runs: DataFrame) -> DataFrame:
    """One row per node of the runs: its place and the segment of its siblings."""
    def side(first: Column, length: Column) -> Column:
        return F.array_join(F.slice("kids.h", first, length), "")

    rows = runs.select("*", F.posexplode("kids").alias("i", "kid"))
    seg = F.struct(side(F.lit(1), F.col("i")).alias("l"),
                   side(F.col("i") + 2, F.size("kids") - F.col("i") - 1).alias("r"))
    return rows.withColumn("segs", F.when(F.col("last"), F.array().cast(SEGMENTS)).otherwise(F.array(seg)))


def _key(tree: Column | str, level: int, at: Column | str) -> Column:
    return F.concat_ws(",", F.lit(level).cast("string"), F.col(at) if isinstance(at, str) else at,
                       F.col(tree) if isinstance(tree, str) else tree)


class _Tree:
    """The levels of all groups' trees (or of the top tree), each written to the checkpoint folder."""

    def __init__(self, nodes: DataFrame, most: int, carry: list[str]):
        self.levels: list[DataFrame] = []
        while most > 0:
            runs = cut_lineage(_runs(nodes, carry if not self.levels else []))
            self.levels.append(runs)
            nodes = runs.filter(~F.col("last")).select("t", F.col("run").alias("at"), "h", "n")
            most = -(-most // FANOUT) if most > 1 else 0

    def tops(self) -> DataFrame | None:
        """The last node of each tree: t, key, h, n."""
        out = None
        for k, runs in enumerate(self.levels):
            some = runs.filter("last").select("t", _key("t", k, F.lit(0)).alias("key"),
                                              F.col("kids")[0]["h"].alias("h"), "n")
            out = some if out is None else out.unionByName(some)
        return out

    def pointers(self, first: int) -> DataFrame | None:
        """key, n, segs, anc, anc_n of every node from level ``first`` on but the trees' last ones."""
        out = None
        for k, runs in list(enumerate(self.levels))[first:]:
            some = _kids(runs.filter(~F.col("last"))).select(
                _key("t", k, "kid.at").alias("key"), F.col("kid.n").alias("n"), "segs",
                _key("t", k + 1, "run").alias("anc"), F.col("n").alias("anc_n"))
            out = some if out is None else out.unionByName(some)
        return out


def _copies(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _jump(nodes: DataFrame) -> DataFrame:
    """Every node with an ancestor takes over that one's ancestor and appends its segments."""
    up = nodes.select(F.col("key").alias("anc"), F.explode(F.sequence(F.lit(0), _copies(F.col("n")) - 1)).alias("salt"),
                      F.col("segs").alias("more"), F.col("anc").alias("next"), F.col("anc_n").alias("next_n"),
                      F.col("sub").alias("up_sub"), F.col("root").alias("up_root"))
    there = nodes.filter("anc IS NULL")
    low = nodes.filter("anc IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("key"), _copies(F.col("anc_n"))).cast("int"))
    met = low.join(up, ["anc", "salt"]).select(
        "key", "n", F.concat("segs", "more").alias("segs"), F.col("next").alias("anc"), F.col("next_n").alias("anc_n"),
        F.coalesce("sub", "up_sub").alias("sub"), F.coalesce("root", "up_root").alias("root"))
    return there.unionByName(met)


def manifest(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Proofs of the leaves in ``rows`` (columns t: key of the group, o: order value, h: leaf
    digest, and the columns to ``carry``): one row per leaf with the carried columns, h, subroot,
    root and segments (array of the joined siblings before, ``l``, and after, ``r``, from the leaf up)."""
    rows = cut_lineage(rows.select("t", "o", "h", *carry))
    ranked = cut_lineage(_ranked(rows, ["o", "h"]).withColumn("n", F.lit(1).cast("long")))
    sizes = ranked.agg((F.max("at") + 1).alias("most")).first()
    most = int(sizes["most"] or 0)
    if not most:
        return rows.select(*carry, "h", F.lit("").alias("subroot"), F.lit("").alias("root"),
                           F.array().cast(SEGMENTS).alias("segments"))
    groups = _Tree(ranked, most, carry)

    subs = cut_lineage(groups.tops())
    placed = cut_lineage(_ranked(subs.withColumnRenamed("t", "name").withColumn("t", F.lit(TOP)), ["name"]))
    top = _Tree(placed, subs.count(), ["key"])
    last = top.tops().select(F.col("key").alias("last"), F.col("h").alias("root"))

    none = F.lit(None).cast("string")
    # subroots are nodes of both trees, here under their key in the group's tree
    first = _kids(top.levels[0]).select(
        F.col("kid.key").alias("key"), F.col("kid.n").alias("n"), "segs",
        F.when(~F.col("last"), _key("t", 1, "run")).alias("anc"), F.col("n").alias("anc_n"),
        F.col("kid.h").alias("sub"), F.when(F.col("last"), F.col("kid.h")).alias("root"))
    nodes = first
    for more in (groups.pointers(1), top.pointers(1)):
        if more is not None:
            nodes = nodes.unionByName(more.select("*", none.alias("sub"), none.alias("root")))
    # a node below the root has arrived: the root is no row of its own
    last = F.broadcast(last.withColumnRenamed("root", "at_root"))  # one row
    nodes = nodes.join(last, F.col("anc") == F.col("last"), "left").select(
        "key", "n", "segs", F.when(F.col("last").isNull(), F.col("anc")).alias("anc"), "anc_n", "sub",
        F.coalesce("root", "at_root").alias("root"))
    nodes = cut_lineage(nodes)
    reach, height = 1, len(groups.levels) + len(top.levels)
    while reach < height:
        nodes = cut_lineage(_jump(nodes))
        reach *= 2

    runs = groups.levels[0].withColumn("key", F.when(F.col("last"), _key("t", 0, F.lit(0))).otherwise(_key("t", 1, "run")))
    paths = nodes.select("key", F.col("segs").alias("path"), F.col("sub").alias("subroot"), "root")
    leaves = _kids(runs.join(paths, "key"))
    return leaves.select(*[F.col(f"kid.{c}").alias(c) for c in carry], F.col("kid.h").alias("h"), "subroot", "root",
                         F.concat("segs", "path").alias("segments"))


def fold(start: Column, segments: Column) -> Column:
    """The root that a leaf digest and its proof lead to."""
    return F.aggregate(segments, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof_digest(segments: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def verify(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
           group: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """Manifest of ``docs`` and a check of every row against it, where the rows for which
    ``tampered`` holds have meanwhile had the A-Z of their text lower-cased."""
    other = F.translate(docs[text].cast("string"), UPPER, LOWER)
    cols = {c: docs[c] for c in columns}
    now = F.when(F.coalesce(tampered, F.lit(False)), leaf(*(cols | {text: other}).values()))
    rows = pick(docs, doc=docs[order], o=docs[order], t=group_key(docs[group]), h=leaf(*cols.values()), now=now)
    proofs = manifest(rows, ["doc", "now"])
    folded = fold(F.coalesce("now", "h"), F.col("segments"))
    out = proofs.select(F.col("doc").alias(order), F.col("h").alias("leaf"), "subroot", "root",
                        proof_digest(F.col("segments")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
