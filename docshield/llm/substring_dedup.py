"""Substring de-duplication by sliding sentence spans.

A text is cut into sentences (after ``.``, ``!``, ``?`` and at line ends).  Long sentences are cut
further by content: of every ``WINDOW`` neighbouring words the one that ranks lowest ends a piece
(sentence ends first, then commas, semicolons and colons, then the word's hash).  A cut depends only on
the words beside it, so equal passages get equal cuts wherever their sentence began.  From each sentence
starts a span: the shortest run of at least ``RUN`` sentences and ``WORDS`` words.  A repeat of
``(RUN + 2) * WINDOW`` words always holds a common span.
Spans are hashed (96 bits over ASCII-lower-cased words, from running sums, so each costs the same
whatever its length) and joined globally.  Of equal spans the first in (id, place) order stays; the
words covered by any other one go, and so do the words beside them that also stand beside the first
one, word by word to the passage's edges.  What is left is the original text.

Spans are found once and written as a table (mostly their hashes; the rest compresses) into the
cluster's checkpoint folder, and so are the edges of the covered runs.  Shuffles: the hashes
once, counted map-side, and (hash, id, place) rows once to meet the repeated hashes; the spans of
those are written as well, so that the skew rule can split their join with first places; the texts once, to hand
out the words beside first places and to meet the places to cut; and the edges with at most ``BESIDE``
words each.  No group of equal spans is ever collected.

Defined results: null text counts as empty and gives an empty text; null ids come last in order;
rows with equal id and equal text count as one document and get equal results; a span repeated
inside one document is cut there too; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshield.session import ensure_checkpoint_dir

from .common import cut_lineage, joined, pick, prepare, text_of
from .sketch import _mix, _word_hashes
from .textblocks import word_blocks

RUN = 3
WORDS = 20
WINDOW = 10
#: Words compared beyond a covered run; cuts lie at most ``WINDOW`` words apart, so an edge is nearer.
BESIDE = 4 * WINDOW
#: Copies of the words beside a place, so that no task meets all edges of a common passage.
SALTS = 8

_NO_ID = (1 << 63) - 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_HARD = np.zeros(256, bool)
_HARD[list(b".!?")] = True
_SOFT = np.zeros(256, bool)
_SOFT[list(b",;:")] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


#: Powers are kept up to this exponent; longer texts work theirs out.
_MOST = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64."""
    if n > _MOST:
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
    if base not in _POWERS:
        _POWERS[base] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_MOST, base, np.uint64))))
    return _POWERS[base][:n + 1]


def _lowest(rank: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each value is the lowest of some ``window`` neighbouring ones."""
    n = len(rank) - window + 1
    if n < 1:
        return np.zeros(len(rank), bool)
    low = rank[:n].copy()
    for i in range(1, window):
        np.minimum(low, rank[i:i + n], out=low)
    best = np.zeros_like(rank)
    for i in range(window):
        np.maximum(best[i:i + n], low, out=best[i:i + n])
    return rank == best


class Cut:
    """The sentences of one text: ``edges`` (word index where each starts, and the word count),
    ``starts`` (byte where each word starts) and ``word`` (hash of each lower-cased word)."""

    def __init__(self, raw: bytes):
        self.raw = raw
        buf = np.frombuffer(raw, np.uint8)
        blank = _BLANK[buf]
        solid = np.flatnonzero(np.diff((~blank).astype(np.int8), prepend=0, append=0))
        self.starts, ends = solid[::2], solid[1::2]
        n = self.n_words = len(ends)
        if not n:
            self.edges, self.word = np.zeros(1, np.int64), np.empty(0, np.uint64)
            return
        self.word = np.concatenate([_word_hashes(w) for w in word_blocks(raw.lower())])
        last = buf[ends - 1]
        lines = np.flatnonzero(buf == 10)
        after = np.append(self.starts[1:], len(buf))
        newline = np.searchsorted(lines, after) > np.searchsorted(lines, ends)
        newline[-1] = True
        hard = _HARD[last] | newline
        level = np.where(hard, 0, np.where(_SOFT[last], 1, 2)).astype(np.uint64)
        stop = np.flatnonzero(hard | _lowest(_mix(self.word) >> np.uint64(2) | level << np.uint64(62))) + 1
        self.edges = np.unique(np.concatenate(([0], stop, [n])))

    def spans(self, run: int = RUN, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """(first sentence, sentence after the last) of every span."""
        edges, m = self.edges, len(self.edges) - 1
        first = np.arange(m)
        after = np.maximum(first + run, np.searchsorted(edges, edges[:-1] + words))
        inside = after <= m
        return first[inside], after[inside]

    def hashes(self, first: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
        """Two independent 64-bit hashes of each span."""
        a, b = self.edges[first], self.edges[after]
        out = []
        for base in _BASES:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.word * _powers(base, self.n_words)[:-1])))
            back = _powers(pow(base, -1, 1 << 64), self.n_words)
            out.append(_mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)))
        return out

    def words(self, a: int, b: int) -> list[bytes]:
        """The lower-cased words a ... b - 1, as far as the text has them."""
        a, b = max(a, 0), min(b, self.n_words)
        return self.raw[self.starts[a]:self.starts[b] if b < self.n_words else len(self.raw)].lower().split() if a < b else []

    def beside(self, edge: int, right: bool) -> bytes:
        """The words before or after an edge."""
        at = int(self.edges[edge])
        return b" ".join(self.words(at, at + BESIDE) if right else self.words(at - BESIDE, at))

    def grown(self, a: int, b: int, left: bytes, right: bytes) -> tuple[int, int]:
        """The words of sentences a ... b - 1 and those beside them that are equal to the given ones."""
        a, b = int(self.edges[a]), int(self.edges[b])
        return (a - _equal(reversed(self.words(a - BESIDE, a)), reversed(left.split())),
                b + _equal(self.words(b, b + BESIDE), right.split()))

    def part(self, marked: np.ndarray) -> list[bytes]:
        """The runs of words marked, with the blanks after them (and before the first word)."""
        starts = np.append(self.starts, len(self.raw))
        starts[0] = 0
        runs = starts[np.flatnonzero(np.diff(marked.astype(np.int8), prepend=0, append=0))]
        return [self.raw[i:j] for i, j in zip(runs[::2].tolist(), runs[1::2].tolist())]


def _equal(a: Iterable[bytes], b: Iterable[bytes]) -> int:
    """How many values agree from the start."""
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b)))


def spans(docs: DataFrame, text: str = "text", doc: str = "doc_id", run: int = RUN, words: int = WORDS) -> DataFrame:
    """doc, at, h and g (hash).  ``at`` is the place in one number: first sentence, sentences (8
    bits) and a hash of the text (24 bits, which tells apart rows of equal id)."""
    fields = {"doc": pa.int64(), "at": pa.int64(), "h": pa.int64(), "g": pa.int32()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            rows = 0
            for d, th, t in zip(batch.column("doc"), batch.column("th").to_pylist(), batch.column("text")):
                cut = Cut(t.as_buffer().to_pybytes())
                first, after = cut.spans(run, words)
                n = len(first)
                if not n:
                    continue
                h, g = cut.hashes(first, after)
                made.append((pa.array([d.as_py()] * n, pa.int64()) if not d.is_valid else pa.array(np.full(n, d.as_py())),
                             pa.array((first << 8 | after - first) << 24 | th),
                             pa.array(h.view(np.int64)), pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32))))
                rows += n
                if rows >= 100_000:
                    yield _batch(made, fields)
                    made, rows = [], 0
            if made:
                yield _batch(made, fields)

    body = text_of(docs, text)
    rows = pick(prepare(docs), doc=docs[doc].cast("long"), th=_text_hash(body), text=body.cast("binary"))
    return rows.mapInArrow(find, "doc bigint, at bigint, h bigint, g int")


def _text_hash(body):
    return F.hash(body).bitwiseAND(F.lit((1 << 24) - 1))


def _batch(made: list[tuple], fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*made)], list(fields))


def _place():
    """Orders occurrences; a null id comes last."""
    return F.struct(F.coalesce("doc", F.lit(_NO_ID)).alias("doc"), F.col("at"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated(found: DataFrame) -> DataFrame:
    """doc, th, at, first (doc, at) of the spans that are not the first of their hash (``th``: the text's).

    All spans are shuffled twice: once counted by hash (combined map-side, hashes only), once to meet
    the hashes counted twice or more; first places are then looked for among those spans only."""
    twice = cut_lineage(found.groupBy("h", "g").count().filter("count > 1").select("h", "g"))
    marks = stored(found.join(twice, ["h", "g"]), "marks")
    firsts = cut_lineage(marks.groupBy("h", "g").agg(F.min(_place()).alias("first")))
    both = marks.join(firsts, ["h", "g"]).filter(_place() != F.col("first"))
    return both.select("doc", F.col("at").bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("th"),
                       F.shiftright("at", 24).alias("at"), "first")


def _merged(marks: pa.ListArray) -> tuple[np.ndarray, ...]:
    """The runs of the marks of each row, by row: row, a, b, and where (in the flat marks, given
    last) a run's first mark stands and the mark that reaches its end first."""
    sizes = np.diff(marks.offsets.to_numpy())
    flat = marks.flatten()
    first = flat.field("first")
    at, doc, place = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (flat.field("at"), first.field("doc"), first.field("at")))
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((place, doc, at, row))
    row, at, doc, place = row[order], at[order], doc[order], place[order]
    a = at >> 8
    b = a + (at & 255)
    far = int(b.max(initial=0)) + 1
    reach = np.maximum.accumulate(b + row * far) - row * far  # within a row, as rows ascend
    head = np.ones(len(a), bool)
    head[1:] = (row[1:] != row[:-1]) | (a[1:] > reach[:-1])
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(a)) - 1
    at_end = np.flatnonzero(b == np.repeat(reach[ends], np.diff(np.append(starts, len(a)))))
    run_of = np.cumsum(head) - 1
    last = at_end[np.unique(run_of[at_end], return_index=True)[1]]
    return row[starts], a[starts], reach[ends], starts, last, row, doc, place


def runs(marks: DataFrame) -> DataFrame:
    """Two rows for each run of covered sentences ``a`` ... ``b`` - 1, one a side: doc, th, a, b, right,
    and the place beside which the first one's words stand (f_doc, f_th, f_edge); ``firsts``, the first
    documents, stands in one row of each document."""
    names = ["doc", "th", "a", "b", "right", "f_doc", "f_th", "f_edge", "firsts"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b, start, last, rows, doc, place = _merged(batch.column("marks"))
            right = np.tile([False, True], len(row))
            which = np.stack((start, last), axis=1).ravel()
            f_doc, f_at = doc[which], place[which]
            edge = (f_at >> 32) + (f_at >> 24 & 255) * right
            # the first documents of a row, each once, beside the left side of its first run
            pairs = np.unique(np.stack((rows, doc), axis=1), axis=0)
            row2 = np.repeat(row, 2)
            lead = np.ones(len(row2), bool)
            lead[1:] = row2[1:] != row2[:-1]
            counts = np.where(lead, np.bincount(pairs[:, 0], minlength=batch.num_rows)[row2], 0)
            firsts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(pairs[:, 1]))
            take = pa.array(row2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("th").take(take), pa.array(np.repeat(a, 2)), pa.array(np.repeat(b, 2)),
                 pa.array(right), pa.array(f_doc), pa.array((f_at & (1 << 24) - 1).astype(np.int32)), pa.array(edge), firsts], names)

    grouped = marks.groupBy("doc", "th").agg(F.collect_list(F.struct("at", "first")).alias("marks"))
    return grouped.mapInArrow(merge, "doc bigint, th int, a bigint, b bigint, right boolean, f_doc bigint, f_th int, f_edge bigint, firsts array<bigint>")


def beside(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """f_doc, f_th, f_edge, right, words: the words beside each place that ``sides`` asks for."""
    asked = sides.groupBy("f_doc", "f_th").agg(F.collect_set(F.struct("f_edge", "right")).alias("asked"))
    asked = asked.withColumns({"doc": F.nullif("f_doc", F.lit(_NO_ID)), "th": F.col("f_th")})
    names = ["f_doc", "f_th", "f_edge", "right", "words"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for d, th, asked, t in zip(*[batch.column(c).to_pylist() for c in ("f_doc", "f_th", "asked")], batch.column("text")):
                cut = Cut(t.as_buffer().to_pybytes())
                made += [(d, th, x["f_edge"], x["right"], cut.beside(x["f_edge"], x["right"])) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * len(names), kinds)], names)

    met = joined(rows, asked, ["doc", "th"], "inner").select("f_doc", "f_th", "asked", "text")
    return met.mapInArrow(find, "f_doc bigint, f_th int, f_edge bigint, right boolean, words binary").dropDuplicates(names[:4])


def deduplicate(docs: DataFrame, text: str = "text", doc: str = "doc_id", run: int = RUN, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, text (what is left), n_removed (sentences removed, wholly or in
    part), removed (the removed passages) and first_docs (where their spans stand first)."""
    found = stored(spans(docs, text, doc, run, words), "spans")
    sides = stored(runs(repeated(found)), "runs")
    body = text_of(docs, text)
    rows = pick(docs, doc=docs[doc].cast("long"), th=_text_hash(body), text=body.cast("binary"))
    known = beside(rows, sides).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sides.withColumn("salt", F.pmod(F.hash("doc", "th", "a"), F.lit(SALTS)))
    marks = salted.join(known, ["f_doc", "f_th", "f_edge", "right", "salt"]).groupBy("doc", "th").agg(
        F.collect_list(F.struct("a", "b", "right", "words")).alias("places"), F.flatten(F.collect_list("firsts")).alias("first_docs"))
    marks = marks.withColumn("first_docs", F.transform("first_docs", lambda d: F.nullif(d, F.lit(_NO_ID))))
    marks = marks.withColumn("first_docs", F.filter("first_docs", lambda d: d.isNotNull()))
    rows = joined(rows, marks, ["doc", "th"], "left")
    names = ["doc_id", "text", "n_removed", "removed", "first_docs"]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for t, places in zip(batch.column("text"), batch.column("places").to_pylist()):
                raw = t.as_buffer().to_pybytes()
                touched, lost = 0, []
                if places:  # other texts stay as they are and are not cut again
                    cut = Cut(raw)
                    gone = np.zeros(cut.n_words, bool)
                    ends: dict[tuple[int, int], list[bytes]] = {}
                    for p in places:
                        ends.setdefault((p["a"], p["b"]), [b"", b""])[p["right"]] = p["words"]
                    for (a, b), sides in ends.items():
                        a, b = cut.grown(a, b, *sides)
                        gone[a:b] = True
                    lost = [x.decode().strip() for x in cut.part(gone)]
                    touched = int(np.logical_or.reduceat(gone, cut.edges[:-1]).sum())
                    raw = b"".join(cut.part(~gone))
                for c, v in zip(out, (raw, touched, lost)):
                    c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.string()))
            cols = [pa.array(c, k) for c, k in zip(out, kinds)]
            cols[0] = cols[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *cols, batch.column("first_docs")], names)

    schema = "doc_id bigint, text string, n_removed bigint, removed array<string>, first_docs array<bigint>"
    return rows.select("doc", "text", "places", "first_docs").mapInArrow(clean, schema)
