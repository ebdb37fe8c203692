"""Policies that stay tables: the same rules as the policy in memory, for any size, in batch and stream."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from docshield.functions import guard as G
from docshield.operators import guarding
from docshield.operators import policy_index as P
from docshield.plans import bindings as B
from docshield.sources import stores
from docshield.sources.tables import table
from docshield.streaming import streams

ODD = [" Pass Word ", "PIN", "ab", "é", "", "   ", "c++", "Straße", "report-writing", "zz", "tax", "x1", "s", "the e", "\tund\n"]
TEXTS = ["my pass word is out", "PINS and needles", "spin", "cab", "Café", "learn C++ now", "an der STRASSE", "an der Straße.",
         "report-writing", "a tax, two taxes", "x1x1", "his s", "the end", "und", "rund", "", None, "passwords", "átax", "tax́", "ſ"]


def policy(lists):
    return G.Policy({t: list(p) for t, p in lists.items()}, {t: [] for t in lists}, {t: "d" for t in lists}, {t: "b" for t in lists})


def tables(spark, pol):
    return P.PolicyTables(guarding.policy_rows(spark, pol), guarding.tiers_frame(spark, pol))


def rules(df, pol):
    return {(r["i"], r["rule"]) for r in guarding.tier_hits(df, "text", "tier", pol, "in").collect()}


def rows(spark, texts, tiers):
    return spark.createDataFrame([(i, t, tiers[i % len(tiers)]) for i, t in enumerate(texts)], "i int, text string, tier string")


def test_same_rule_as_expression(spark):
    pol = policy({"Internal": ODD, "Public": [], "Other": list(reversed(ODD))})
    df = rows(spark, [t for t in TEXTS for _ in range(5)], ["Internal", "Public", "Other", "unheard", None])
    assert rules(df, tables(spark, pol)) == rules(df, pol)


def test_null_patterns_and_missing_fallback(spark):
    rows_of = spark.createDataFrame([("Mine", "in", 0, None), ("Mine", "in", 1, "salt")], "tier string, direction string, ord int, pattern string")
    pol = P.PolicyTables(rows_of, spark.createDataFrame([("Mine",)], "tier string"))
    df = rows(spark, ["salt", "my api key", "salt", "my api key"], ["Mine", "Mine", "else", "else"])
    assert rules(df, pol) == {(0, "salt"), (1, None), (2, None), (3, "api key")}


def test_empty_tables(spark):
    pol = policy({"Internal": [], "Public": []})
    assert rules(rows(spark, TEXTS, ["Internal"]), tables(spark, pol)) == {(i, None) for i in range(len(TEXTS))}
    assert rules(rows(spark, TEXTS, ["Internal"]).limit(0), tables(spark, policy({"Internal": ODD}))) == set()


def test_hundred_thousand_patterns(spark):
    rng = random.Random(5)
    many = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", " x", "1"]) for _ in range(100_001)]
    texts = [" ".join("".join(rng.choice("abcdes1 ") for _ in range(7)) for _ in range(12)) for _ in range(40)] + ["q" * 200_000 + " abcdea1"]
    df = rows(spark, texts, ["Internal"])
    pol = policy({"Internal": [f"Q{p}" for p in many[:24]] + many})
    assert rules(df, tables(spark, pol)) == rules(df, pol)
    few = policy({"Internal": many[:24]})
    assert rules(df, tables(spark, few)) == rules(df, few)


def test_violations_and_checks_equal(spark, sf):
    pol = G.Policy.default()
    req = B.requests(table(spark, sf, "conversations"))
    names = ["conv_id", "turn", "ord", "pattern"]
    got = P.violations(req, "question", "tier", tables(spark, pol), "in", ["conv_id", "turn"]).select(*names)
    want = guarding.violations(req, "question", "tier", "in", keep=["conv_id", "turn"]).filter("kind = 'tier'").select(*names)
    assert sorted(got.collect()) == sorted(want.collect())
    told = guarding.check_input(req, policy=tables(spark, pol))
    assert sorted(map(str, told.collect())) == sorted(map(str, guarding.check_input(req).collect()))


def test_clashing_columns_and_copies(spark):
    df = rows(spark, ["tax"] * 50, ["Internal"]).withColumns({"sha": F.lit("x"), "pattern": F.lit("y"), "ord": F.lit(1), "low": F.lit("z")})
    got = guarding.tier_hits(df, "text", "tier", tables(spark, policy({"Internal": ["Tax"]})), "in")
    assert got.columns == [*df.columns, "rule"] and [r["rule"] for r in got.collect()] == ["Tax"] * 50
    every = P.violations(df, "text", "tier", tables(spark, policy({"Internal": ["Tax", "TAX"]})), keep=["i"])
    assert every.count() == 100


def test_stored_tables(spark):
    base = tempfile.mkdtemp(prefix="docshield-test-")
    assert P.load_policy_tables(spark, base + "/none").known().count() == 4
    stores.save_policy_tables(tables(spark, policy({"Internal": ["salt"]})), base)
    assert [r["pattern"] for r in P.load_policy_tables(spark, base).cleaned("in").collect()] == ["salt"]
    stores.save_policy(spark, G.Policy.default(), base)
    assert P.load_policy_tables(spark, base).cleaned("in").count() == sum(map(len, G.TIER_INPUT_PATTERNS.values()))


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_runs_of_equal_text_are_equal(length):
    text = "ein süßer 🍰 und ein süßer 🍰"
    h = P.run_hashes(text, length)
    assert len(h) == len(text) - length + 1
    assert len(set(h.tolist())) == len({text[i:i + length] for i in range(len(h))})


def test_stream_with_policy_tables(spark, sf):
    """T2 with a policy that stays a table, over two micro-batches, equals the batch form."""
    rows_in = B.answered_requests(table(spark, sf, "conversations"))
    pol = P.PolicyTables(B.passage_policy(table(spark, sf, "benchmark")), guarding.tiers_frame(spark))
    base = tempfile.mkdtemp(prefix="docshield-test-")

    def start():
        src = streams.read_stream(spark, base + "/in/*", rows_in, max_files=1000)
        return streams.stream_turns(src, base + "/out", base + "/ckpt", policy=pol)

    streams.deliver([rows_in.where(F.col("conv_id") % 2 == k) for k in (0, 1)], base + "/in", start)
    cols = ["conv_id", "turn", "source", "blocked", "shown", "rule"]
    got = streams.read_epochs(spark, base + "/out", "responses").select(*cols).collect()
    want = streams.responses(rows_in, pol).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r["rule"] for r in want)
