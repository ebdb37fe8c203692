"""Chunking (C1, C1b, C2, C3, C4).

C1 is the public recursive character splitter (separators ``\\n\\n``, ``\\n``, space, empty;
separator kept at the start of the next piece; greedy merge to ``size``; carry back at most
``overlap``; strip; drop empties).  Sizes are characters.  Splitting one text is row-local,
so it runs as an Arrow batch job (``mapInArrow``); scale comes from the number of documents.
C1b is the fixed-window form, fully native (``sequence`` + ``substring``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docshield.operators.ordinal import ordinal_in_groups

SEPARATORS = ["\n\n", "\n", " ", ""]
#: Documents that are split at a time.
DOCS_HELD = 128


# ---------------------------------------------------------------- pure-Python splitter
def _split_keep(text: str, sep: str) -> list[str]:
    if not sep:
        return list(text)
    parts = re.split("(" + re.escape(sep) + ")", text)
    out = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts) - 1, 2)]
    return [p for p in out if p != ""]


def _merge(splits: list[str], size: int, overlap: int) -> list[str]:
    docs, cur, total = [], [], 0
    for d in splits:
        n = len(d)
        if total + n > size and cur:
            joined = "".join(cur).strip()
            if joined:
                docs.append(joined)
            while total > overlap or (total + n > size and total > 0):
                total -= len(cur[0])
                cur = cur[1:]
        cur.append(d)
        total += n
    joined = "".join(cur).strip()
    if joined:
        docs.append(joined)
    return docs


def split_text(text: str, size: int = 1000, overlap: int = 200,
               separators: list[str] = SEPARATORS) -> list[str]:
    """Recursive character split of one text (C1 semantics)."""
    if text is None:
        return []
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, separators[i + 1:]
            break
    out, good = [], []
    for piece in _split_keep(text, sep):
        if len(piece) < size:
            good.append(piece)
            continue
        if good:
            out.extend(_merge(good, size, overlap))
            good = []
        if not rest:
            out.append(piece)
        else:
            out.extend(split_text(piece, size, overlap, rest))
    if good:
        out.extend(_merge(good, size, overlap))
    return out


# ---------------------------------------------------------------- Spark operators
def chunk(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200,
          keep: list[str] | None = None) -> DataFrame:
    """C1 + C2: one row per chunk (``chunk_idx``, ``chunk_text``), other columns kept."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    keep = [c for c in (keep if keep is not None else df.columns) if c != text]
    src = df.select(*keep, text)
    in_schema = src.schema
    out_schema = T.StructType([f for f in in_schema.fields if f.name != text] + [
        T.StructField("chunk_idx", T.IntegerType(), False),
        T.StructField("chunk_text", T.StringType(), True)])

    def run(batches):
        import pyarrow as pa
        # some documents at a time, so that neither their strings nor their chunks add up to the batch
        for b in (b.slice(at, DOCS_HELD) for b in batches for at in range(0, b.num_rows, DOCS_HELD)):
            texts = b.column(text).to_pylist()
            idx_rows, idxs, chunks = [], [], []
            for r, t in enumerate(texts):
                for i, c in enumerate(split_text(t, size, overlap)):
                    idx_rows.append(r)
                    idxs.append(i)
                    chunks.append(c)
            # carried columns are gathered by Arrow (no per-value Python objects)
            carried = b.select(keep).take(pa.array(idx_rows, type=pa.int64())) if keep else None
            arrays = [carried.column(n) for n in keep] + [pa.array(idxs, type=pa.int32()),
                                                          pa.array(chunks, type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + ["chunk_idx", "chunk_text"])

    return src.mapInArrow(run, out_schema)


def window_count(length, size: int, overlap: int):
    """C1b count: 1 + ceil(max(0, L - size) / (size - overlap)); 0 for empty text."""
    stride = size - overlap
    return F.when(length <= 0, F.lit(0)).otherwise(
        1 + F.ceil(F.greatest(length - size, F.lit(0)) / F.lit(stride)).cast("int"))


def chunk_windows(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200,
                  keep: list[str] | None = None, drop_blank: bool = True) -> DataFrame:
    """Fixed windows with stride size - overlap, native (no Python).

    The windows are cut inside the row (``transform`` over ``sequence``) before ``explode``,
    so each output row carries its chunk only, not a copy of the whole document."""
    stride = size - overlap
    keep = [c for c in (keep if keep is not None else df.columns) if c != text]
    n = window_count(F.length(text), size, overlap)
    # No row filter on ``n``: Catalyst would push it below an expensive projection of
    # ``text`` (e.g. redaction) and evaluate that twice.  Empty texts get an empty array.
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        idx,
        lambda i: F.struct(i.alias("chunk_idx"), (i * stride).alias("chunk_start"),
                           F.substring(F.col(text), i * stride + 1, F.lit(size)).alias("chunk_text")))
    out = (df.select(*keep, F.explode(windows).alias("_w"))
             .select(*keep, "_w.chunk_idx", "_w.chunk_start", "_w.chunk_text"))
    if drop_blank:
        out = out.where(F.trim("chunk_text") != "")
    return out


def chunk_stats(chunks: DataFrame, by: str = "source", doc: str = "doc_id") -> DataFrame:
    """Documents in, chunks out, mean and max chunk length per group."""
    return chunks.groupBy(by).agg(
        F.countDistinct(doc).cast("bigint").alias("n_docs"),
        F.count(F.lit(1)).cast("bigint").alias("n_chunks"),
        F.round(F.avg(F.length("chunk_text")), 4).alias("avg_chars"),
        F.max(F.length("chunk_text")).cast("bigint").alias("max_chars"))


def load_batches(chunks: DataFrame, collection: str = "collection", order=("doc_id", "chunk_idx"),
                 batch_rows: int = 100) -> DataFrame:
    """C4: batch number = floor((row_number - 1) / 100) per collection, hot-group safe."""
    numbered = ordinal_in_groups(chunks, [collection], list(order), out="_rn")
    return numbered.withColumn("batch", F.floor((F.col("_rn") - 1) / batch_rows).cast("bigint")).drop("_rn")


def page_spans(chunks: DataFrame, pages: DataFrame, doc: list[str], width: int = 4096) -> DataFrame:
    """V4: first and last page of text stretches, by an interval join over bins of ``width`` characters.

    ``chunks``: the ``doc`` columns, chunk_idx, chunk_start, chunk_end (exclusive); ``pages``: the
    ``doc`` columns, page (from 0), start (its offset in the same text).  A page reaches to the next
    one's start, the last one to the end of the stretches.  Both sides are dealt to the bins they
    touch and meet by (document, bin), so a long document spreads over many tasks.  Returns the key,
    page and page_last; stretches outside all pages are left out."""
    from pyspark.sql import Window

    def bins(lo, hi):  # the bins of [lo, hi); an empty stretch lies at its start
        return F.explode(F.sequence(F.floor(lo / width), F.floor(F.greatest(hi - 1, lo) / width))).alias("_bin")

    c = chunks.select(*doc, "chunk_idx", "chunk_start", F.greatest("chunk_end", F.col("chunk_start") + 1).alias("_end")).distinct()
    ends = c.groupBy(*doc).agg(F.max("_end").alias("_total"))
    w = Window.partitionBy(*doc).orderBy("start", "page")
    p = (pages.select(*doc, "page", "start").withColumn("_next", F.lead("start").over(w)).join(ends, doc)
         .withColumn("_stop", F.coalesce("_next", F.greatest("_total", F.col("start") + 1)))
         .where(F.col("_stop") > F.col("start")).select(*doc, "page", F.col("start").alias("_from"), "_stop"))
    left = c.select("*", bins(F.col("chunk_start"), F.col("_end")))
    right = p.select("*", bins(F.col("_from"), F.col("_stop")))
    met = left.join(right, [*doc, "_bin"]).where((F.col("_from") < F.col("_end")) & (F.col("chunk_start") < F.col("_stop")))
    return met.groupBy(*doc, "chunk_idx").agg(F.min("page").alias("page"), F.max("page").alias("page_last"))
