"""Odd inputs that every operator has to take, and small brute-force forms."""

from __future__ import annotations

import re
import struct
from collections import defaultdict

import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{i % 977} of{i % 13}." for i in range(60_000))

ODD = [
    (1, "One plain text with a few words in it.", "en", "a", 38),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (5, LONG, "en", "a", len(LONG)),
    (6, "One plain text\nwith a few words in it.", "en", "c", 38),
    (7, "One plain text with a few words in it.", "en", "a", 38),
    (7, "One plain text with a few words in it.", "en", "a", 38),
    (None, "No id here, only text.", "en", "a", 22),
    (None, None, None, None, None),
    (8, "x" * 50_000, "en", "é", 50_000),
    (9, "naïve café 日本語 🙂     end", "fr", "é", 30),
    (-5, "Licensed under CC BY-NC 4.0.\nmail a.b@example.com", "en", "b", 48),
]

#: Column names that operators use for themselves.
CLASHING = ["_row", "doc", "th", "fp", "sha", "md5", "size", "source_size", "target", "copies", "content", "salt",
            "score", "keep", "body", "hits", "made", "clean", "ids", "part", "place", "h", "g", "at", "keep_id", "best", "row"]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    from pyspark.sql import functions as F

    df = odd(spark)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def dedup_brute(rows):
    """{row index: (keep_id, group_size)} of (doc_id, text) rows."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    out = {}
    for members in groups.values():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        for i in members:
            out[i] = (rows[best][0], len(members))
    return out


def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(values, most=2):
    """{value: smallest linked value's class representative} by comparing all pairs."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= most:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def order_hash(doc_id):
    """The engine's signed 64-bit hash of a bigint."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42) if doc_id is not None else 42
    return h - (1 << 64) if h >> 63 else h


def targets_brute(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target} by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] >= cap * sizes[s]}
        if not full:
            return out | {s: per * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out
