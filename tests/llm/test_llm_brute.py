"""Operators against brute force, exact round trips and held-out labels."""

import hashlib
import html
import random
import re
import sys
from collections import Counter, defaultdict
from os.path import dirname

import numpy as np
import pytest

sys.path.insert(0, dirname(__file__))
import llm_cases as cases  # noqa: E402

from docshield.llm import bpe, exact_dedup, html_extract, licences, mixing, pii, quality, simhash, sketch, substring_dedup, textblocks  # noqa: E402
from docshield.llm.catalog import vocabulary  # noqa: E402
from docshield.llm.graph import components  # noqa: E402
from docshield.llm.htmlblocks import blocks  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# -- exact duplicates ------------------------------------------------------------------------------
def test_dedup_is_brute_force(docs, texts):
    rows = list(texts.items())
    want = cases.dedup_brute(rows)
    for r in exact_dedup.assignments(docs, salts=3).collect():
        i = [d for d, _ in rows].index(r["doc_id"])
        assert (r["keep_id"], r["group_size"]) == want[i] and r["kept"] == (r["keep_id"] == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", texts[r["doc_id"]]).encode()).hexdigest()


# -- SimHash ---------------------------------------------------------------------------------------
def _clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 60])):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            out.add(v)
        base = 0xFFFF0000 << 16 if rng.random() < 0.5 else v
        out.add(base ^ sum(1 << b for b in rng.sample(range(20), 3)))
    return sorted(out)


@pytest.mark.parametrize("parts,crowd", [(3, 64), (3, 6), (2, 16)])
def test_links_are_all_pairs(spark, parts, crowd):
    values = _clustered(400, parts * 10 + crowd)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(3)
    got = {(r["a"], r["b"]) for r in simhash.links(fps, 2, parts, crowd).collect()}
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i]
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and want


def test_thresholds_keep_the_principle():
    rng = np.random.default_rng(0)
    for parts in (2, 3, 4):
        cost = [[0.0, *np.cumsum(rng.random(3)).tolist()] for _ in range(parts)]
        t = simhash.thresholds(cost, 2 - parts + 1)
        assert sum(t) == 2 - parts + 1 and min(t) >= -1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 50)) and got[201] == 200


def test_simhash_near_copies(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta iota kappa".split(), k=300)) for _ in range(4)]
    rows = [(i * 10 + j, b if j == 0 else b + " tail" * (j % 3)) for i, b in enumerate(base) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fp = {d: cases.simhash_brute(t) for d, t in rows}
    comp = cases.components_brute(fp.values())
    first = defaultdict(list)
    for d, v in fp.items():
        first[comp[v]].append(d)
    for r in simhash.near_duplicates(df).collect():
        assert r["component_id"] == min(first[comp[fp[r["doc_id"]]]])


@pytest.mark.parametrize("size", [1 << 20, 5, 17])
def test_fingerprint_in_blocks(monkeypatch, size):
    monkeypatch.setattr(simhash, "word_blocks", lambda raw: textblocks.word_blocks(raw, size))
    rng = random.Random(size)
    for _ in range(80):
        t = "".join(rng.choice(["a", "B", "É", " ", " ", "\n", "\x0b", "ß", "cd "]) for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == cases.simhash_brute(t)


# -- BPE -------------------------------------------------------------------------------------------
def _library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    with open(vocabulary(), "rb") as f:
        return bpe.Bpe(f.read())


HARD = ["", "<|endoftext|>", "a<|endoftext|>b  c", "a" * 23, " " * 50 + "x" + " " * 7, "\n\n \n x\t\ty", "日本語テスト🙂🙂🙂",
        "it's I'LL we've", "\x1c\x1d x \x85 y　z", "é" * 9, "ab" * 1000, " a", "a ", "  ", "a  b", "a \n b", "x   y", "1 2  33½"]


def test_bpe_equals_the_library(own, texts):
    lib = _library()
    every = [*HARD, *texts.values()]
    assert [x.tolist() for x in own.encode(every)] == [lib.encode(t, add_special_tokens=False).ids for t in every]
    assert [own.decode(x) for x in own.encode(every)] == every


def test_bpe_random_and_cut_texts(own, monkeypatch):
    lib = _library()
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "a", "'s", "B", "9", "é", "!", " ", "🙂", "the", "<|endoftext|>"]
    some = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(400)]
    monkeypatch.setattr(bpe, "SEGMENT", 11)
    monkeypatch.setattr(bpe, "GROUP", 50)
    monkeypatch.setattr(bpe, "KEPT", 30)
    assert [x.tolist() for x in own.encode(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]


def test_bpe_every_character(own):
    lib = _library().pre_tokenizer
    for c in [*range(0, 0xD800, 7), *range(0xE000, 0x20000, 11)]:
        s = f"a{chr(c)}1 {chr(c)}!"
        assert own.pattern.findall(s) == [s[a:b] for _, (a, b) in lib.pre_tokenize_str(s)]


def test_bpe_tables(docs, texts):
    table = bpe.encode(docs, vocabulary())
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(table, vocabulary()).collect()}
    assert back == texts
    r = bpe.digests(bpe.encode_and_decode(docs.limit(1), vocabulary())).first()
    assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# -- quality ---------------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["keep"] for r in quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got]
    good = [got[d] for d, q in labels if q == 1]
    bad = [got[d] for d, q in labels if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    hit = [0.45, 0.3, 0.4, 0.35, 0.25, 0.3]
    false = [0.02, 0.01, 0.03, 0.01, 0.02, 0.01]
    votes = np.stack([np.where(rng.random(20_000) < 0.1, quality.ABSTAIN,
                               np.where(rng.random(20_000) < np.where(truth, f, h), quality.BAD, quality.GOOD)) for h, f in zip(hit, false)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table, post = quality.fit_labellers(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.06 and np.abs(table[0, :, quality.BAD] - hit).max() < 0.1


# -- PII -------------------------------------------------------------------------------------------
def _luhn(s):
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def _mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


PRIVATE = {
    1: "card 4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111",
    2: "no card 4111111111111112, no date 2001-02-30, no address 300.1.1.1, no number 000-12-3456",
    3: "born 1984-02-29, again 29.02.1984 and 29/02/1984",
    4: "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 DE89370400440532013001",
    5: "+1 (372) 555-7739 or +1-372-555-7739, ssn 123-45-6789, host 97.51.17.173",
    6: "erüver.34@mail7.example.com wrote Erüver.34@mail7.example.com",
    7: 'token = "ede43f42c939b6405768150e0411590525cf889e"',
}


def test_pii_formats_and_links(spark):
    df = spark.createDataFrame(list(PRIVATE.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.protect(df).collect()}
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"\d[\d -]{13,}\d", got[1])]
    assert len(set(cards)) == 1 and _luhn(cards[0]) and cards[0] != "4111111111111111"
    assert [re.sub(r"\d", "0", x) for x in got[1].split()] == [re.sub(r"\d", "0", x) for x in PRIVATE[1].split()]
    assert got[2] == PRIVATE[2]
    iso, dots, slashes = re.findall(r"[\d./-]{10}", got[3])
    y, m, d = iso.split("-")
    assert dots == f"{d}.{m}.{y}" and slashes == f"{d}/{m}/{y}" and iso != "1984-02-29"
    gb, de, same = re.fullmatch(r"(GB.*) (DE\d+) (DE\d+)", got[4]).groups()
    assert _mod97(gb) == _mod97(de) == 1 and same == "DE89370400440532013001" and de != "DE89370400440532013000"
    a, b = re.findall(r"\+1.*?\d{4}", got[5])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "13725557739" and "97.51.17.173" not in got[5] and "123-45-6789" not in got[5]
    assert len(set(re.findall(r"\S+@\S+", got[6]))) == 1 and "34@" not in got[6] and got[6].endswith("@mail7.example.com")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[7]) and got[7] != PRIVATE[7]
    other = {r["doc_id"]: r["text"] for r in pii.protect(df, key="another").collect()}
    assert all(other[i] != got[i] for i in got if i != 2)


def test_pii_finds_cards_beside_other_digits(spark):
    texts = ["pay 4111 1111 1111 1111 123 now", "pay 4111 1111 1111 1111 12/25 now", "no 12 4111-1111-1111-1111 now",
             "amex 3782 822463 10005 1234", "none 4111 1111 1111 1112 123"]
    got = [r["text"] for r in pii.protect(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert [re.sub(r"\d", "0", x) for x in got] == [re.sub(r"\d", "0", x) for x in texts]
    for t, g, card in zip(texts, got, ("4111 1111 1111 1111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005")):
        at = t.index(card)
        new = g[at:at + len(card)]
        assert new != card and _luhn(new) and (g[:at], g[at + len(card):]) == (t[:at], t[at + len(card):])
    assert got[4] == texts[4]


def test_pii_is_a_permutation(spark):
    """All days of four years, and many short numbers, keep distinct and stay in their format."""
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2000, 2001, 2004) for m in range(1, 13) for d in range(1, 29)]
    cards = [s for s in (f"4000{i:012d}" for i in range(3000)) if _luhn(s)]
    df = spark.createDataFrame(list(enumerate([*days, *cards])), "doc_id bigint, text string")
    got = [r["text"] for r in pii.protect(df).orderBy("doc_id").collect()]
    assert len(set(got)) == len(got)
    assert all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in got[:len(days)]) and all(_luhn(x) for x in got[len(days):])


def test_layouts_of_a_phone_number_stay_linked(spark):
    """One number with and without country code and separators; two numbers stay two."""
    layouts = ["+1 (555) 019-2834", "+1 555 019 2834", "+15550192834", "+1-555-019-2834", "(555) 019-2834", "555-019-2834", "555.019.2834"]
    others = ["+44 20 7946 0958", "+442079460958", "+353 1 234 5678x", "+353 12 345 6789", "+353123456789"]
    df = spark.createDataFrame([(i, f"call {t} now") for i, t in enumerate(layouts + others)], "doc_id bigint, text string")
    got = [r["text"][5:-4] for r in pii.protect(df).orderBy("doc_id").collect()]
    national = [re.sub(r"\D", "", re.sub(r"^\+1", "", t)) for t in got[:len(layouts)]]
    assert len(set(national)) == 1 and len(national[0]) == 10 and national[0] != "5550192834"
    assert [re.sub(r"\d", "0", t) for t in got] == [re.sub(r"\d", "0", t) for t in layouts + others]
    assert all(t.startswith("+1") for t in got[:4]) and got[7][:3] == got[8][:3] == "+44"
    assert re.sub(r"\D", "", got[7]) == re.sub(r"\D", "", got[8]) != "442079460958"
    assert re.sub(r"\D", "", got[10]) == re.sub(r"\D", "", got[11]) and got[10].startswith("+353 ")


def test_dates_before_a_time(spark):
    df = spark.createDataFrame([(1, "at 1984-02-29T10:00:00 or 1984-02-29 or 1984-02-29Tx")], "doc_id bigint, text string")
    a, b, c = re.findall(r"(?:at|or) (\S+)", pii.protect(df).first()["text"])
    assert a != "1984-02-29T10:00:00" and a == b + "T10:00:00" and c == "1984-02-29Tx"


def test_pii_leaves_no_planted_value(docs, texts):
    got = {r["doc_id"]: r["text"] for r in pii.protect(docs).collect()}
    for d, t in texts.items():
        values = [*re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", t), *re.findall(r"[\w.]+@mail\d\.example\.com", t),
                  *(x for x in re.findall(r"(?<!\d)\d{16}(?!\d)", t) if _luhn(x)), *re.findall(r"\b[0-9a-f]{40}\b", t)]
        assert not any(v in got[d] for v in values)
        if not re.search(r"\d|@", t):
            assert got[d] == t


# -- licences --------------------------------------------------------------------------------------
PHRASES = {"MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
           "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
           "Proprietary": "All rights reserved."}


def test_licences_are_found(docs, texts):
    for r in licences.licences(docs).collect():
        assert set(r["families"]) == {f for f, p in PHRASES.items() if p in texts[r["doc_id"]]}


def test_licences_tell_versions_and_talk_apart(spark):
    lines = ["Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 2.",
             "I need a license to drive a car in version 3.", "The Apache license is popular", "permission to enter was granted",
             "noise *** Released under the MIT License. more", "Copyright 2020 Foo. All rights reserved."]
    got = [r["family"] for r in licences.licences(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got == ["CC-BY-4.0", "GPL-2.0", None, None, None, "MIT", "Proprietary"]


def test_licences_without_stems_and_over_lines(spark):
    gpl = ("it under the terms of the GNU General\nPublic License as published by the Free Software\nFoundation, either version 3 of "
           "the License, or\n(at your option) any later version.")
    texts = ["some words\nAll rights reserved.\nmore words", "Released under the GNU GPL version 3.", f"Title\n\n{gpl}\n\nThe end",
             "Released under the MIT License.\nmore of it", "All her rights were\nreserved for\nanother day"]
    got = licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in got] == [["Proprietary"], ["GPL-3.0"], ["GPL-3.0"], ["MIT"], []]
    assert [r["n_paragraphs"] for r in got] == [1, 1, 1, 1, 0]


@pytest.mark.parametrize("family", sorted(licences.TEMPLATES))
def test_anchors_follow_from_the_overlap(family):
    """A notice stripped of all anchors is under the overlap."""
    for t in licences.TEMPLATES[family]:
        every = set(licences.grams(licences.words(t)))
        rest = {g for g in every if not set(g.split()) & set(licences.anchors())}
        assert len(rest) < licences.OVERLAP * len(every)


# -- repeated passages -----------------------------------------------------------------------------
def test_passages_stay_once(spark):
    rng = random.Random(5)

    def prose(n):
        out = []
        while len(out) < n:
            k = rng.randint(1, 25)
            out += ["".join(rng.choices("abcdefghij", k=5)) for _ in range(k)]
            out[-1] += rng.choice([".", ".", ".", ",", "!"])
        return " ".join(out[:n]).rstrip(",!.") + "."

    passages = [prose(n) for n in (55, 60, 80, 120, 300)]
    rows = []
    for i in range(60):
        p = passages[i % 5]
        sep = "\n" if i % 2 else " "
        rows.append((i, prose(40) + sep + p + sep + prose(30)))
    clean = [(100 + i, prose(90)) for i in range(20)]
    df = spark.createDataFrame(rows + clean, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in substring_dedup.deduplicate(df).collect()}
    for i in range(5):
        assert passages[i] in got[i]["text"].replace("\n", " ") and got[i]["n_removed"] == 0
    for d, t in rows[5:]:
        p = passages[d % 5].split()
        left = got[d]["text"].split()
        grams = {tuple(left[k:k + 20]) for k in range(len(left) - 19)}
        assert not any(tuple(p[k:k + 20]) in grams for k in range(len(p) - 19)), d
        assert got[d]["first_docs"] == [d % 5] and got[d]["removed"]
        assert len(left) >= 55
    for d, t in clean:
        assert got[d]["text"] == t and got[d]["n_removed"] == 0


def test_passages_inside_sentences_stay_once(spark):
    """Passages of one or two sentences without commas, put in the middle of other sentences."""
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    passages = [words(60) for _ in range(20)]
    for p in passages[10:]:
        p[rng.randint(15, 45)] += "."
    rows = [(i, " ".join([*words(rng.randint(3, 40)), *passages[i % 20], *words(rng.randint(3, 40))]) + ".") for i in range(80)]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    for d, t in rows:
        p = " ".join(passages[d % 20])
        a, b = t.split(p)
        assert got[d]["text"] == (t if d < 20 else a + b.lstrip()), d
        assert got[d]["removed"] == ([] if d < 20 else [p]) and (got[d]["first_docs"] is None) == (d < 20)
        assert d < 20 or d % 20 in got[d]["first_docs"]


def test_span_hashes_depend_on_words_only():
    a, b = substring_dedup.Cut(b"x y. One two three. four five six seven. " * 3), substring_dedup.Cut(b"One two\tthree. Four five  six seven. x Y. " * 3)
    ha = {h for h in a.hashes(*a.spans(3, 5))[0].tolist()}
    hb = {h for h in b.hashes(*b.spans(3, 5))[0].tolist()}
    assert ha & hb


# -- pages -----------------------------------------------------------------------------------------
def test_field_on_held_out_layouts():
    pages = html_extract.labelled_pages(120, seed=99)
    field = html_extract.default_field()
    wrong = total = 0
    for page, labels in pages:
        got = field.decode(blocks(page))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong / total < 0.03


def test_pages_give_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    right = 0
    for r in html_extract.extract(pages).collect():
        m = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)
        right += r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[1])).split())
    assert right >= 0.98 * len(source)


# -- sketches --------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 4, 50])
def test_neighbours_are_brute_force(docs, texts, parts):
    order = sorted(texts)
    rows = sketch.neighbours(docs, parts=parts).collect()
    assert sorted(r["doc_id"] for r in rows) == order
    known = {}
    for r in rows:
        t, nxt = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        h, e, x = (sketch.sketch(s.encode()) for s in (t, edited, nxt))
        assert (r["near_edited"], r["near_next"]) == (sketch.containment(h, e), sketch.containment(h, x))
        assert r["fingerprint"] == sketch.shown(h) == known.setdefault(t, r["fingerprint"])


def _true(a, b, shingle=5):
    """(containment of the smaller, Jaccard, shingles of the smaller) by sets of word tuples."""
    def grams(t):
        w = t.split()
        return {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()

    x, y = grams(a), grams(b)
    if not x or not y:
        return float(x == y), float(x == y), 0
    both = len(x & y)
    return both / min(len(x), len(y)), both / len(x | y), min(len(x), len(y))


def test_whole_sketches_have_true_containment():
    rng = random.Random(4)
    big = [f"w{rng.randint(0, 10**6)}" for _ in range(500)]
    for n in (5, 8, 12, 20, 40):
        for _ in range(20):
            at = rng.randint(0, 500 - n)
            small = big[at:at + n] + [f"x{i}" for i in range(n // 3)]
            texts = " ".join(small), " ".join(big)
            assert sketch.containment(*[sketch.sketch(t.encode(), level=0) for t in texts]) == _true(*texts)[0]


@pytest.mark.parametrize("n", [1, 5, 8, 12, 20, 40, 52, 100, 400, 2_000, 20_000])
def test_error_is_as_stated(n):
    """Edited texts of 5 to 20,000 words: exact while sketched whole, else within four standard errors."""
    rng = random.Random(n)
    errors = []
    for _ in range(20 if n < 5000 else 4):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        cut = rng.randint(0, n)
        other = words[:cut] + [f"x{rng.randint(0, 10**6)}" for _ in range(n - cut)]
        a, b = " ".join(words), " ".join(other)
        s, t = sketch.sketch(a.encode()), sketch.sketch(b.encode())
        want, jac, size = _true(a, b)
        level = max(s.level, t.level)
        assert len(s.hashes) >= min(sketch.LEAST, size) and len(sketch.shown(s)) <= 1 + sketch.DIGITS * len(s.hashes)
        kept = min(len(s.at(level)), len(t.at(level)))
        limit = 4 * (want * (1 - want) / max(kept, 1)) ** 0.5 + 2 / max(kept, 1) if level else 0
        assert abs(sketch.containment(s, t) - want) <= limit
        errors.append(sketch.containment(s, t) - want)
        assert abs(sketch.jaccard(s, t) - jac) <= (0.35 if level else 1e-12)
    assert abs(sum(errors) / len(errors)) <= 0.07
    assert (level == 0) == (n < sketch.LEAST) or n in (52, 100)


def test_fingerprints_are_smaller_than_texts(docs, texts):
    made = [sketch.shown(sketch.sketch(t.encode())) for t in texts.values()]
    assert sum(map(len, made)) < 0.4 * sum(len(t.encode()) for t in texts.values())


def test_sketch_estimates_and_merges():
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(20_000)]
    big, small = " ".join(words).encode(), " ".join(words[3000:5000]).encode()
    a, b = sketch.sketch(big), sketch.sketch(small)
    assert a.level == sketch.LEVEL and abs(sketch.containment(a, b) - 1) < 0.02 and abs(sketch.jaccard(a, b) - 0.1) < 0.04
    for parts in ((" ".join(words[:11_000]), " ".join(words[10_996:])), (" ".join(words[:19_900]), " ".join(words[19_896:]))):
        merged = sketch.union(*[sketch.sketch(t.encode()) for t in parts])
        assert merged.level == a.level and np.array_equal(merged.hashes, a.hashes)
    # the same words again and again: few distinct shingles, kept whole, whatever the length
    assert sketch.sketch(b"a b c " * 600_000).level == 0


# -- mixing ----------------------------------------------------------------------------------------
def test_mix_meets_targets(spark, docs, texts):
    rows = mixing.mix(docs, parts=16).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    total = Counter()
    for d in size:
        total[source[d]] += size[d]
    want = cases.targets_brute(total)
    taken, largest = Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - want[s]) < 1e-6 * want[s] + 1e-9
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.5 * largest[s] + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7), parts=64).collect()))


def test_mix_selects_by_order_in_hot_cells(spark):
    """One cell holds most rows: the copies go to the first rows by hash, found range by range."""
    rows = [(i, "w " * 5, "a") for i in range(2000)] + [(5000 + i, "w " * (i + 1), "b") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), parts=32).collect()
    hot = [r for r in got if r["source"] == "a"]
    base = min(r["copies"] for r in hot)
    extra = [r["doc_id"] for r in hot if r["copies"] > base]
    assert extra and set(extra) == set(sorted((r["doc_id"] for r in hot), key=lambda d: (cases.order_hash(d), d))[:len(extra)])
    assert abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 5


def test_tilt_solves_the_dual(spark):
    hist = spark.createDataFrame([("a", n, c) for n, c in ((1, 50), (10, 20), (200, 3), (5000, 1))], "source string, size bigint, n bigint")
    goals = spark.createDataFrame([("a", 5850, 2000.0)], "source string, source_size bigint, target double")
    r = mixing.solve(hist, goals).first()
    e = {n: np.exp(r["tilt"] * n / r["scale"]) for n in (1, 10, 200, 5000)}
    got = sum(c * n * 2 * e[n] / (1 + e[n]) for n, c in ((1, 50), (10, 20), (200, 3), (5000, 1)))
    assert abs(got - 2000) < 1
