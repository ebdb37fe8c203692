"""Token maps as of a request, the best-scoring sentence, and pages of citations, against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docshield.functions import chat as C
from docshield.operators import chunking, redaction

TYPES = [
    ("LITERAL", r"\[(?:CREDENTIAL|EMAIL|CREDIT_CARD|SSN|PHONE|NAME|LITERAL)_\d+\]"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("SSN", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    ("PHONE", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"),
    ("NAME", r"(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"),
]


class Loop:
    """One request after the other, with the map as a dict, as an application would keep it."""

    def __init__(self):
        self.tokens = defaultdict(dict)   # (collection, type) -> {value: token}
        self.values = defaultdict(dict)   # collection -> {token: value}

    def take_in(self, collection, text):
        parts = [(None, text)]
        for kind, rx in TYPES:
            cut = []
            for k, s in parts:
                if k:
                    cut.append((k, s))
                    continue
                at = 0
                for m in re.finditer(rx, s):
                    cut += [(None, s[at:m.start()]), (kind, m[0])]
                    at = m.end()
                cut.append((None, s[at:]))
            parts = cut
        out = ""
        for kind, s in parts:
            if kind:
                known = self.tokens[collection, kind]
                if s not in known:
                    known[s] = f"[{kind}_{len(known) + 1}]"
                    self.values[collection][known[s]] = s
                s = known[s]
            out += s
        return out

    def show(self, collection, text):
        return re.sub(TYPES[0][1], lambda m: self.values[collection].get(m[0], m[0]), text)


PEOPLE = ["Dr. Ada Byron", "Mrs. Grace Hopper", "Prof. Emmy Noether", "Mr. Smith"]
PIECES = [*PEOPLE, "grace@navy.example.org", "a.b@x.example.com", "000-12-3456", "+1 (555) 019-2834", "555 019 2834",
          "[PHONE_1]", "[NAME_7]", "[LITERAL_1]", "who wrote", "is it", "and", "?"]


@pytest.mark.parametrize("seed", [1, 2])
def test_tokens_as_of_a_request_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    docs = [(f"c{i % 2}", i, " ".join(rng.choices(PIECES, k=rng.randint(0, 4)))) for i in range(8)]
    asked = [(f"c{rng.randint(0, 2)}", s, t, " ".join(rng.choices(PIECES, k=rng.randint(0, 5)))) for s in range(6) for t in range(0, 8, 2)]
    answer = "[PHONE_1] [PHONE_2] [NAME_1] [NAME_2] [NAME_3] [EMAIL_1] [LITERAL_1] [LITERAL_2] [SSN_1] [SSN_99]"

    loop, want, known = Loop(), {}, {}
    for c, i, t in sorted(docs, key=lambda d: d[1]):
        known[c, i] = loop.take_in(c, t)
    for c, s, t, q in asked:  # in order of session and turn
        want[s, t] = (loop.take_in(c, q), loop.show(c, answer))

    d = spark.createDataFrame(docs, "collection string, doc_id long, text string")
    tokenised, mapping = redaction.tokenize_pii(d)
    assert {(r["collection"], r["doc_id"]): r["text_tokens"] for r in tokenised.collect()} == known
    q = spark.createDataFrame(asked, "collection string, conv_id long, turn long, question string")
    texts, versions = redaction.tokenize_asof(q, mapping, "collection", ["conv_id", "turn"], "question", "used")
    rows = texts.withColumn("key", F.concat_ws(":", "conv_id", "turn")).withColumn("answer", F.lit(answer)) \
        .withColumn("many", F.array(F.lit("none"), F.lit(answer), F.lit(None).cast("string")))
    shown = redaction.rehydrate(rows, versions, "collection", "key", "answer", "back", asof="_arrival")
    got = {(r["conv_id"], r["turn"]): (r["used"], r["back"]) for r in shown.collect()}
    assert got == want
    lists = redaction.rehydrate_array(rows, versions, "collection", "key", "many", "back", asof="_arrival")
    for r in lists.collect():
        assert r["back"][:2] == ["none", want[r["conv_id"], r["turn"]][1]]
    # the order of arrival matters: some request saw fewer tokens than the last one of its collection
    late = redaction.rehydrate(rows, versions, "collection", "key", "answer", "back")
    assert any(r["back"] != want[r["conv_id"], r["turn"]][1] for r in late.collect())


def best_brute(question, texts):
    def terms(s):
        return {w for w in re.findall(r"[^\W_]+", s.lower())}

    best = (0, 0, 0, C.NO_CONTEXT_ANSWER)
    for r, t in enumerate(texts or []):
        for i, s in enumerate(re.findall(r"[^.!?\n]+[.!?]*", t or "")):
            s = s.strip(" \t\n\r\f")
            own = terms(s)
            m = len(own & terms(question or ""))
            score = 1000 * m * m // max(len(own), 1)
            if score > 0:
                best = max(best, (score, -r, -i, s), key=lambda x: x[:3])
    return best[3]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ab .!?\nÉ", max_size=12), st.lists(st.text("ab .!?\nÉ", max_size=30), max_size=4)), min_size=1, max_size=8))
def test_best_sentence_is_brute_force(spark, rows):
    rows = [*rows, (None, ["a"]), ("a", None), ("who ate the fish", ["Rain. A cat ate the fish! Done.", "The fish."])]
    df = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(rows)], "i int, q string, t array<string>")
    got = [r["a"] for r in df.select("i", C.best_sentence(F.col("q"), F.col("t")).alias("a")).orderBy("i").collect()]
    assert got == [best_brute(q, t) for q, t in rows]


def test_page_spans_are_brute_force(spark):
    rng = random.Random(5)
    chunks, pages, want = [], [], {}
    for d in range(6):
        starts = sorted({0, *(rng.randrange(30_000) for _ in range(rng.randint(0, 8)))}) if d else []
        pages += [("c", d, p, s) for p, s in enumerate(starts)]
        for i in range(30):
            lo = rng.randrange(31_000)
            hi = lo + rng.choice([0, 1, 1000, 9000])
            chunks.append(("c", d, i, lo, hi))
            on = [p for p, s in enumerate(starts) if s < max(hi, lo + 1) and (p + 1 == len(starts) or lo < starts[p + 1])]
            if on:
                want[d, i] = (min(on), max(on))
    c = spark.createDataFrame(chunks, "collection string, doc_id long, chunk_idx int, chunk_start int, chunk_end int")
    p = spark.createDataFrame(pages, "collection string, doc_id long, page int, start int")
    got = {(r["doc_id"], r["chunk_idx"]): (r["page"], r["page_last"]) for r in chunking.page_spans(c, p, ["collection", "doc_id"]).collect()}
    assert got == want


def test_private_turn_hides_and_shows(spark, sf):
    """No question or stored answer holds a planted value; some citation shows an original again."""
    from docshield.plans import bindings as B
    from docshield.plans import turns
    from docshield.sources.tables import table
    from docshield.streaming import streams
    conv, docs = table(spark, sf, "conversations"), table(spark, sf, "documents")
    texts = docs.select(F.col("source").alias("collection"), "doc_id", "source", "text")
    index, mapping = turns.build_private_index(texts, streams.scratch_dir(spark, "private"))
    assert index.where(F.col("chunk_text").rlike(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}")).count() == 0
    resp = turns.run_turns(B.private_requests(conv, docs), index, conv, mapping=mapping, requests_are_turns=True, pages=B.page_starts(docs))
    rows = resp.collect()
    hidden = r"Byron|Hopper|Noether|\(555\) 019|grace@|1111-2222"
    for r in rows:
        if r["source"] != "input_guard":
            assert not re.search(hidden, r["question_used"]) and not re.search(hidden, r["stored_answer"])
    assert any("[NAME_1]" in (r["question_used"] or "") for r in rows)
    pages = {c["page"] for r in rows for c in r["citations"]}
    assert None in pages and 1 in pages
