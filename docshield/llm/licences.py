"""Licence scans: a trained paragraph classifier with template confirmation (DataFrame functions).

Paragraphs are the lines of a text, and the lines between blank lines joined (a notice may be wrapped);
joined lines count where none of them is confirmed as the same family.  A paragraph becomes hashed word unigrams and bigrams (lower-case
runs of letters, digits and plus signs, and dots between digits).

1. Trained classifier: multinomial logistic regression over the hashed n-grams, one class per licence
   family and one class "unknown".  It is fitted once, from the templates (whole, in parts, and with
   words dropped) and from ordinary sentences about licences, software and law as unknown class.
2. Calibration: the unknown class's bias is raised until no held-out unknown sentence is taken for a
   licence and the confidence limit ``LIMIT`` separates the rest.
3. Confirmation: the n-grams of the predicted family's templates are compared with the paragraph; the
   prediction stands if it holds at least ``OVERLAP`` of the n-grams of one of them.

Of any words that touch more than ``1 - OVERLAP`` of a template's n-grams a confirmed paragraph must hold
one.  Such words, as rare as possible, are chosen from every template (``anchors``), and paragraphs
without one are not scored.  Weights are one literal of the plan (a
few hundred KB, whatever the input).  The shuffles are those of one aggregate by document and its
join with the documents, both without texts.

Defined results: null text counts as empty; documents without a licence paragraph have an empty list
and family null; rows of equal id and text share one result; several licences give several families, the first by place is ``family``; repeated
rows give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, pick, text_of

DIM = 2048
LIMIT = 0.6
OVERLAP = 0.7

#: Licence notices (fixed values: their public wording, or short forms in common use).
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU GPL version 2 license.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 3 license.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "MPL-2.0": [
        "This file is licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0-1.0": [
        "Dedicated to the public domain under the CC0 1.0 license.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Proprietary": [
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without prior written permission of the copyright holder.",
    ],
}
UNKNOWN = "unknown"
#: Words of templates that other texts are full of; they are no anchors.
COMMON = frozenset("a an and any as at be by clause code domain either file for form free from general in is it its later may mit no not "
                   "of on only option or part person project public published software source subject terms that the this to under "
                   "use v version with without work written you your".split())
#: Sentences that mention licences without granting one (our own).
OTHERS = [
    "She lost her driving license on the way to the office.", "A fishing license costs ten dollars in this county.",
    "The bar had its liquor license revoked last spring.", "He asked for permission to leave the room early.",
    "Parents must give written permission before the trip.", "The license plate was covered in mud.",
    "Which license should we choose for the new project?", "Compare the MIT license with the Apache license before you decide.",
    "The lawyer explained copyright law to the students.", "Copyright disputes may take years to settle in court.",
    "The software vendor raised its license fees again.", "Poetic license allows some freedom with grammar.",
    "The hunting license expires at the end of the year.", "Permission denied: the file could not be opened.",
    "The committee will license new doctors in the autumn.", "The public version of the report is general in tone.",
    "Version 3 of the plan was released to the public yesterday.", "This work is part of a general public debate.",
    "Under the terms of the agreement the rent stays the same.", "The foundation published its general report on free software.",
    "He works under a license from the city council.", "The commons were open to the public in the past.",
    "A source close to the project declined to comment on the license.", "The library is subject to opening hours set by the council.",
    "The GNU project has a long history.", "Apache is also the name of a people.", "Students of MIT built a robot.",
    "No license is needed to paint your own house.", "The copyright page of a book names its printer.",
    "All rights and duties pass to the new owner.", "The author kept the rights to the film.",
]


def normalised(text: Column) -> Column:
    """Words separated and surrounded by one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}+.]+|\.(?![\p{N}])|(?<![\p{N}])\.", " ")), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalised(text), " +"), lambda w: w != "")


def words(text: str) -> list[str]:
    """The same words on the driver, for the templates."""
    return re.sub(r"[^\w+.]+|_|\.(?!\d)|(?<!\d)\.", " ", text.lower()).split()


def grams(ws: list[str]) -> list[str]:
    return [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]


def gram_column(ws: Column) -> Column:
    pairs = F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(ws, F.coalesce(pairs, F.array().cast("array<string>")))


@functools.cache
def anchors(overlap: float = OVERLAP) -> tuple[str, ...]:
    """Words of which any paragraph that holds ``overlap`` of a template's n-grams has one."""
    out: set[str] = set()
    for notices in TEMPLATES.values():
        for t in notices:
            ws, every = words(t), set(grams(words(t)))
            most = len(every) - math.ceil(overlap * len(every) - 1e-9)  # n-grams that may be missing
            left, taken = set(every), 0
            while taken <= most:
                touch = {w: sum(w in g.split() for g in left) for w in ws if re.fullmatch("[a-z]+[0-9]*", w)}
                best = max(touch, key=lambda w: (touch[w] > 0, w in out, w not in COMMON, len(w) if w in COMMON else touch[w], len(w)))
                if not touch[best]:
                    raise ValueError(f"no anchors for {t}")
                out.add(best)
                taken += touch[best]
                left = {g for g in left if best not in g.split()}
    return tuple(sorted(out))


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % DIM


def bucket_column(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % DIM).cast("int")


class Model:
    """classes, weights (classes, DIM) and biases; the first class is ``UNKNOWN``."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray):
        self.classes, self.weights, self.bias = classes, weights, bias


def _vector(ws: list[str]) -> np.ndarray:
    x = np.zeros(DIM)
    for g in set(grams(ws)):
        x[bucket(g)] = 1
    return x / max(1.0, np.sqrt(x.sum()))


def _examples(seed: int = 3) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Vectors and classes: templates, templates inside other words, templates with a word dropped;
    other sentences, whole and mixed."""
    rng = np.random.default_rng(seed)
    classes = [UNKNOWN, *TEMPLATES]
    other = [words(s) for s in OTHERS]
    xs, ys = [], []
    for y, family in enumerate(classes):
        for ws in ([words(t) for t in TEMPLATES[family]] if y else other):
            xs.append(_vector(ws))
            ys.append(y)
            for _ in range(8):
                keep = [w for w in ws if rng.random() > 0.06] if y else [w for w in ws if rng.random() > 0.2]
                around = other[rng.integers(len(other))]
                cut = rng.integers(0, len(around) + 1)
                mixed = around[:cut] + keep if rng.random() < 0.5 else keep + around[cut:]
                if y or rng.random() < 0.5:
                    xs.append(_vector(mixed))
                    ys.append(y)
    return np.array(xs, np.float32), np.array(ys), classes


@functools.cache
def trained(rounds: int = 250, ridge: float = 2e-4) -> Model:
    """Multinomial logistic regression by accelerated gradient, then the calibrated unknown bias."""
    x, y, classes = _examples()
    held = np.arange(len(y)) % 5 == 0
    tx, ty = x[~held], y[~held]
    k = len(classes)
    hot = np.eye(k, dtype=np.float32)[ty]
    share = (1 / np.bincount(ty, minlength=k)[ty] / k).astype(np.float32)
    w, b = np.zeros((k, DIM), np.float32), np.zeros(k, np.float32)
    v, c = w, b
    step = np.float32(1) / (0.5 * (share[:, None] * tx * tx).sum() + share.sum() * 0.5 + ridge)
    for t in range(rounds):
        z = tx @ v.T + c
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = share[:, None] * (p - hot)
        nw, nb = v - step * (d.T @ tx + ridge * v), c - step * d.sum(0)
        v, c, w, b = nw + np.float32(t / (t + 3)) * (nw - w), nb + np.float32(t / (t + 3)) * (nb - b), nw, nb
    # the unknown class: as high as keeps the held-out notices, so that other texts fall to it
    hx, hy = x[held], y[held]
    z = hx @ w.T + b
    gap = z[:, 1:].max(1) - z[:, 0]
    known, rest = gap[hy > 0], gap[hy == 0]
    shift = (np.quantile(known, 0.02) + rest.max(initial=known.min())) / 2 - 0.4
    b = b.copy()
    b[0] += shift
    return Model(classes, w, b)


def paragraphs(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc, th (hash of the text), place and last (first and last line), line of the paragraphs that hold an
    anchor.  A document without one is passed over before it is cut."""
    body = text_of(docs, text)
    rows = pick(docs, doc=docs[doc].cast("long"), th=F.xxhash64(body), text=body)
    # one pass over the text; case does not matter
    anchor = rf"(?iu)(?<![\p{{L}}\p{{N}}+])(?:{'|'.join(anchors())})(?![\p{{L}}\p{{N}}+])"
    rows = rows.filter(F.col("text").rlike(anchor)).withColumn("lines", F.split("text", r"\r?\n|\r"))
    rows = rows.withColumn("full", F.transform("lines", lambda x: x.rlike(r"\S")))
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    full = lambda i: F.coalesce(F.get("full", i), F.lit(False))
    first = F.filter(at, lambda i: full(i) & ~full(i - 1))
    last = F.filter(at, lambda i: full(i) & ~full(i + 1))
    rows = rows.withColumn("runs", F.filter(F.arrays_zip(first.alias("place"), last.alias("last")), lambda r: r["last"] > r["place"]))
    single = F.transform("lines", lambda x, i: F.struct(i.alias("place"), i.alias("last"), x.alias("line")))
    whole = F.transform("runs", lambda r: F.struct(r["place"].alias("place"), r["last"].alias("last"), F.array_join(
        F.slice("lines", r["place"] + 1, r["last"] - r["place"] + 1), " ").alias("line")))
    rows = rows.select("doc", "th", F.explode(F.concat(single, whole)).alias("p")).select("doc", "th", "p.*")
    return rows.filter(F.col("line").rlike(anchor))


def scored(lines: DataFrame, model: Model, limit: float = LIMIT, overlap: float = OVERLAP) -> DataFrame:
    """Adds family, confidence and overlap; family is null where nothing is confirmed."""
    k = len(model.classes)
    # one constant, folded to an array when the plan is optimised
    table = F.from_json(F.lit(json.dumps(np.round(model.weights.T, 4).tolist())), "array<array<double>>")
    rows = lines.withColumn("grams", F.array_distinct(gram_column(tokens(F.col("line")))))
    rows = rows.withColumn("at", F.array_distinct(F.transform("grams", bucket_column)))
    zero = F.array_repeat(F.lit(0.0), k)
    total = F.aggregate("at", zero, lambda acc, i: F.zip_with(acc, F.get(table, i), lambda a, b: a + b))
    size = F.sqrt(F.greatest(F.size("at"), F.lit(1)).cast("double"))
    bias = F.from_json(F.lit(json.dumps(model.bias.tolist())), "array<double>")
    rows = rows.withColumn("z", F.zip_with(total, bias, lambda t, b: t / size + b))
    top = F.array_max("z")
    rows = rows.withColumn("best", F.array_position("z", top) - 1)
    rows = rows.withColumn("confidence", 1 / F.aggregate(F.transform("z", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))
    names = F.array(*[F.lit(c) for c in model.classes])
    rows = rows.withColumn("guess", F.get(names, F.col("best").cast("int")))
    notices = [[sorted(set(grams(words(t)))) for t in TEMPLATES.get(c, [])] for c in model.classes]
    own = F.get(F.from_json(F.lit(json.dumps(notices)), "array<array<array<string>>>"), F.col("best").cast("int"))
    share = F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(F.col("grams"), t)) / F.size(t)))
    rows = rows.withColumn("overlap", F.coalesce(share, F.lit(0.0)))
    sure = (F.col("guess") != UNKNOWN) & (F.col("confidence") >= limit) & (F.col("overlap") >= overlap)
    return rows.select("doc", "th", "place", "last", "line", F.when(sure, F.col("guess")).alias("family"), "confidence", "overlap")


def confirmed(docs: DataFrame, text: str, doc: str, model: Model | None) -> DataFrame:
    """doc, th, hits (place, family, confidence, last, line, overlap) of the documents with licence paragraphs."""
    # the condition stands in the aggregate: as a filter it would be pushed below the scoring and repeat it
    hit = F.when(F.col("family").isNotNull(), F.struct("place", "family", "confidence", "last", "line", "overlap"))
    found = scored(paragraphs(docs, text, doc), model or trained()).groupBy("doc", "th").agg(
        F.array_sort(F.collect_list(hit)).alias("hits")).filter(F.size("hits") > 0)
    return found.withColumn("hits", F.expr(
        "filter(hits, x -> x.last = x.place OR NOT exists(hits, y -> y.last = y.place AND y.family = x.family AND y.place BETWEEN x.place AND x.last))"))


def scan(docs: DataFrame, text: str = "text", doc: str = "doc_id", model: Model | None = None) -> DataFrame:
    """One row per licence paragraph: doc_id, place (its first line), line, family, confidence, overlap."""
    found = confirmed(docs, text, doc, model).select(F.col("doc").alias("doc_id"), F.explode("hits").alias("hit"))
    return found.select("doc_id", *[F.col(f"hit.{c}").alias(c) for c in ("place", "line", "family", "confidence", "overlap")])


def licences(docs: DataFrame, text: str = "text", doc: str = "doc_id", model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, family (the first found, else null), families (sorted),
    n_paragraphs, confidence (of the first)."""
    found = confirmed(docs, text, doc, model).select(
        "doc", "th", F.get("hits", F.lit(0)).alias("first"), F.size("hits").alias("n"),
        F.array_sort(F.array_distinct(F.col("hits.family"))).alias("families"))
    keys = pick(docs, doc=docs[doc].cast("long"), th=F.xxhash64(text_of(docs, text)))
    rows = joined(keys, found, ["doc", "th"], "left")
    return rows.select(F.col("doc").alias("doc_id"), F.col("first.family").alias("family"),
                       F.coalesce("families", F.array().cast("array<string>")).alias("families"),
                       F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), F.col("first.confidence").alias("confidence"))
