"""Byte-level BPE encoding and decoding with a pair occurrence index.

A partition is read in batches.  Texts are cut to chunks at single spaces, where no piece of the
pre-tokeniser can cross; chunks are numbered, and the pieces of the chunks not met before by this
worker are laid end to end in one symbol array.  An index
maps every adjacent pair that has a merge rank to all its positions.  Active ranks are taken in
ascending order; the positions of a rank are merged at once, and the lists of the pairs that this
creates are extended.  Entries that a merge has made stale are recognised when they are read.

The vocabulary file is read once on the driver and broadcast (a few MB, whatever the input).
Encoded chunks are kept per worker up to ``KEPT`` chunks, then forgotten.  Very long texts are cut
where no piece can cross (before a single space between two other characters), so memory is bounded
by the batch and ``SEGMENT``, and the result is that of the whole text.

Defined results: null text counts as empty and has no tokens; the strings of the vocabulary's added
tokens become their ids, as in the public library; repeated rows give equal results; an empty table
gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import pick, prepare, text_of

#: Chunks kept encoded per worker, and characters handled at a time.
KEPT = 150_000
SEGMENT = 1 << 20
GROUP = 4 << 20

#: The white space and the contractions of the public pre-tokeniser's pattern.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


@functools.cache
def classes() -> tuple[str, str]:
    """Letters and numbers as the insides of character classes.  Two public tables of general
    categories give them; where their Unicode versions differ, the public pre-tokeniser is asked,
    so that the classes are those of its own version."""
    splits = ByteLevel(add_prefix_space=False).pre_tokenize_str
    codes = [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]
    every = "".join(map(chr, codes))
    out = []
    for kind, probe in (("L", "a"), ("N", "1")):
        newer = set(regex.findall(rf"\p{{{kind}}}", every))
        inside = [ch in newer if (unicodedata.category(ch)[0] == kind) == (ch in newer)
                  else len(splits(probe + ch)) == 1 for ch in every]
        edges = np.flatnonzero(np.diff(np.array(inside, np.int8), prepend=0, append=0)).tolist()
        out.append("".join(f"\\U{codes[i]:08x}-\\U{codes[j - 1]:08x}" for i, j in zip(edges[::2], edges[1::2])))
    return out[0], out[1]


def piece_pattern(letters: str, numbers: str) -> re.Pattern:
    return re.compile(f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+"
                      f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class _Numbers(dict):
    """key -> its number, in order of first appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for i in at, end to end."""
    n = size[at]
    total = int(n.sum())
    shift = start[at] - (np.cumsum(n) - n)
    return flat[np.repeat(shift, n) + np.arange(total)]


class Bpe:
    def __init__(self, raw: bytes, specials: bool = True, kinds: tuple[str, str] | None = None):
        """raw: a tokenizer file of the public library (byte-level BPE).  specials: whether added
        tokens that occur in a text become their ids (the library's default).  kinds: ``classes()``,
        which the driver works out once for all workers."""
        spec = json.loads(raw)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {ch: b for b, ch in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        top = max([*vocab.values(), *added.values()]) + 1
        plain = [b""] * top
        for token, i in vocab.items():
            plain[i] = bytes(byte_of[ch] for ch in token)
        for token, i in added.items():
            plain[i] = token.encode()
        self.size = np.fromiter(map(len, plain), np.int64, top)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.byte_id = np.array([vocab[ch] for ch in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.pattern = piece_pattern(*(kinds or classes()))
        names = sorted(added, key=len, reverse=True) if specials else []
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.cut = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")
        self.spaces = {"", *SPACES}
        self.forget()

    def forget(self) -> None:
        self.numbers, self.known = _Numbers(), 0
        self.flat, self.at, self.len = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.loose = np.empty(0, bool)

    # -- merging -------------------------------------------------------------------------------
    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.ranks[i], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, number of ids of each piece)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(pieces) else 0
        sym = np.full(n + 1, -1, np.int32)  # the last one is a fence that no pair has
        sym[:n] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        follow = np.minimum(np.arange(1, n + 2), n)
        before = np.arange(-1, n)
        filled = size > 0
        follow[ends[filled] - 1] = n
        before[(ends - size)[filled]] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter the pairs that start at the given positions under their ranks."""
            rank = self._rank(sym[at], sym[follow[at]])
            some = rank >= 0
            rank, at = rank[some], at[some]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            first = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, places in zip(rank[first].tolist(), np.split(at, first[1:])):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(places)

        note(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[follow[at]] == b)]
            if a == b and len(at) > 1:  # overlapping occurrences: every second of a run, from its left
                chained = np.concatenate(([False], follow[at[:-1]] == at[1:]))
                run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = follow[at]
            after = follow[gone]
            sym[at], sym[gone] = self.made[r], -2
            follow[at], before[after] = after, at
            before[n] = n
            note(np.unique(np.concatenate((before[at], at))))
        live = sym[:n] >= 0
        owner = np.repeat(np.arange(len(pieces)), size)[live]
        return sym[:n][live], np.bincount(owner, minlength=len(pieces)).astype(np.int64)

    def _learn(self) -> None:
        """Encode the chunks numbered since the last call: pieces first, then their chunks."""
        if len(self.numbers) == self.known:
            return
        new = list(itertools.islice(self.numbers, self.known, None))
        texts = [c[0] if isinstance(c, tuple) else " " + c for c in new]
        pieces = _Numbers()
        made = [[pieces[p] for p in self.pattern.findall(t)] for t in texts]
        ids, count = self.merge([p.encode() for p in pieces])
        many = np.fromiter(map(len, made), np.int64, len(made))
        which = np.fromiter(itertools.chain.from_iterable(made), np.int64, int(many.sum()))
        each = np.add.reduceat(np.append(count[which], 0), np.minimum(np.cumsum(many) - many, len(which))) * (many > 0)
        loose = np.fromiter((not isinstance(c, tuple) and (c[:1] in self.spaces or c[-1:] in self.spaces) for c in new),
                            bool, len(new))
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(each) - each))
        self.len = np.concatenate((self.len, each))
        self.loose = np.concatenate((self.loose, loose))
        self.flat = np.concatenate((self.flat, _gather(ids, np.cumsum(count) - count, count, which)))
        self.known = len(self.numbers)

    # -- texts ---------------------------------------------------------------------------------
    def segments(self, text: str) -> Iterator[str]:
        """Parts of at most about SEGMENT characters that no piece crosses."""
        start = 0
        while len(text) - start > SEGMENT:
            m = self.cut.search(text, start + SEGMENT)
            if not m:
                break
            yield text[start:m.start()]
            start = m.start()
        yield text[start:] if start else text

    def _parts(self, text: str) -> Iterator[str | int]:
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield self.added[part]
            elif part:
                yield from self.segments(part)

    def _numbered(self, chunks: list) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))

    def _chunks(self, text: str) -> np.ndarray:
        """Chunk numbers when every space stands alone between two other characters, the usual
        case: a chunk is then a space and what follows it, and the first has no space."""
        first, *rest = text.split(" ")
        if rest and (not first or first[-1] in self.spaces):
            return self._strict(text)
        return self._numbered([(first,), *rest])

    def _strict(self, text: str) -> np.ndarray:
        """Chunk numbers of any text: cut only where a space does stand alone."""
        edges = [0, *(m.start() for m in self.cut.finditer(text)), len(text)]
        return self._numbered([(text[a:b],) for a, b in zip(edges, edges[1:])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str | int, np.ndarray | None]] = []
        chars = 0

        def flush() -> None:
            self._learn()
            redo = [k for k, (_, _, x) in enumerate(held) if x is not None and self._is_loose(x)]
            for k in redo:
                i, part, _ = held[k]
                held[k] = (i, part, self._strict(part))
            if redo:
                self._learn()
            for i, part, x in held:
                out[i].append(np.array([part], np.int32) if x is None else _gather(self.flat, self.at, self.len, x))
            held.clear()
            if self.known > KEPT:
                self.forget()

        for i, text in enumerate(texts):
            for part in self._parts(text):
                plain = isinstance(part, str)
                held.append((i, part, self._chunks(part) if plain else None))
                chars += len(part) if plain else 1
                if chars >= GROUP:
                    flush()
                    chars = 0
        flush()
        empty = np.empty(0, np.int32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else empty for x in out]

    def _is_loose(self, x: np.ndarray) -> bool:
        """Whether a space may touch other white space."""
        return bool(self.loose[x].any())

    def decode(self, ids: np.ndarray) -> str:
        parts = [_gather(self.bytes, self.start, self.size, ids[k:k + SEGMENT]).tobytes()
                 for k in range(0, len(ids), SEGMENT)]
        return b"".join(parts).decode("utf-8", "replace")


_LOADED: dict[tuple[str, bool], Bpe] = {}


def loaded(raw: bytes, kinds: tuple[str, str], specials: bool = True) -> Bpe:
    """One tokeniser per worker and vocabulary."""
    key = (hashlib.sha256(raw).hexdigest(), specials)
    if key not in _LOADED:
        _LOADED[key] = Bpe(raw, specials, kinds)
    return _LOADED[key]


def _sent(df: DataFrame, vocabulary: str):
    """The vocabulary file and the character classes, read on the driver and broadcast."""
    with open(vocabulary, "rb") as f:
        return prepare(df).sparkSession.sparkContext.broadcast((f.read(), classes()))


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about GROUP bytes in one column."""
    size = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(name)), np.int64, batch.num_rows)
    part = np.cumsum(size) // GROUP
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _run(df: DataFrame, vocabulary: str, specials: bool, doc: str, text: str, with_decoded: bool) -> DataFrame:
    sent = _sent(df, vocabulary)
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if with_decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(*sent.value, specials)
        for batch in batches:
            for rows in _slices(batch, "text"):
                ids = bpe.encode(rows.column("text").to_pylist())
                cols = [rows.column("doc"), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if with_decoded:
                    cols.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = pick(df, doc=df[doc].cast("long"), text=text_of(df, text))
    schema = "doc_id bigint, n_tokens bigint, ids binary" + ", decoded string" * with_decoded
    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", doc: str = "doc_id", specials: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of each row."""
    return _run(docs, vocabulary, specials, doc, text, False)


def encode_and_decode(docs: DataFrame, vocabulary: str, text: str = "text", doc: str = "doc_id",
                      specials: bool = True) -> DataFrame:
    """As ``encode``, plus ``decoded``: the text that the ids give back."""
    return _run(docs, vocabulary, specials, doc, text, True)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", doc: str = "doc_id") -> DataFrame:
    """doc_id, decoded of rows with an ``ids`` column as ``encode`` makes it (null: no ids)."""
    sent = _sent(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(*sent.value)
        for batch in batches:
            for rows in _slices(batch, "ids"):
                texts = [bpe.decode(np.frombuffer(x.as_buffer() if x.is_valid else b"", "<u4").astype(np.int64))
                         for x in rows.column("ids")]
                yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return pick(encoded, doc=encoded[doc].cast("long"), ids=encoded[ids]).mapInArrow(run, "doc_id bigint, decoded string")


def digests(table: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of an ``encode_and_decode`` result."""
    return table.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
