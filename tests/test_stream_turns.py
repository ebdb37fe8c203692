"""Stream sinks under one epoch, keyed session state, quantiles and digests of large groups."""

import hashlib
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from docshield.operators import audit
from docshield.operators import fingerprint as FP
from docshield.plans import bindings as B
from docshield.sources.tables import table
from docshield.streaming import streams


def folder():
    return tempfile.mkdtemp(prefix="docshield-test-")


def test_replayed_epoch_equals_batch(spark, sf):
    """The second micro-batch fails after its first sink; nothing of it is read until it is replayed."""
    rows = B.answered_requests(table(spark, sf, "conversations"))
    base, failed = folder(), []

    def start(write=streams._write_epoch):
        src = streams.read_stream(spark, base + "/in/*", rows, max_files=1000)
        return streams.stream_turns(src, base + "/out", base + "/ckpt", write=write)

    def breaks(df, path, epoch):
        if path.endswith("audit") and not failed:
            failed.append(epoch)
            raise RuntimeError("lost")
        streams._write_epoch(df, path, epoch)

    first, second = (rows.where(F.col("conv_id") % 2 == k) for k in (0, 1))
    streams.deliver([first], base + "/in", start)
    second.write.parquet(base + "/in/part-1")
    with pytest.raises(Exception, match="lost"):
        start(breaks).awaitTermination()
    assert failed == [1]
    cols = ["conv_id", "turn", "source", "blocked", "shown", "rule"]

    def read(sink, names):
        return sorted(map(str, streams.read_epochs(spark, base + "/out", sink).select(*names).collect()))

    def batch(df):
        return sorted(map(str, streams.responses(df).select(*cols).collect()))

    assert read("responses", cols) == batch(first)
    start().awaitTermination()
    assert read("responses", cols) == batch(rows)
    events = audit.turn_events(streams.responses(rows).withColumn("n_citations", F.lit(0)))
    assert read("audit", events.columns) == sorted(map(str, events.collect()))
    assert streams.read_epochs(spark, folder() + "/none", "audit") is None


def test_responses_equal_both_guards(spark, sf):
    from docshield.operators import guarding
    rows = B.answered_requests(table(spark, sf, "conversations"))
    asked = {(r["conv_id"], r["turn"]): r["in_message"] for r in guarding.check_input(rows).collect()}
    told = {(r["conv_id"], r["turn"]): r["out_message"] for r in guarding.check_output(rows).collect()}
    for r in streams.responses(rows).collect():
        k = (r["conv_id"], r["turn"])
        want = "input_guard" if asked[k] else "output_guard" if told[k] else "llm"
        assert (r["source"], r["shown"]) == (want, asked[k] or told[k] or r["answer"])


REQ = "conv_id long, turn long, custom_rules array<string>, model string, host string, system_prompt string, at timestamp"


def ask(spark, *rows):
    made = [(c, t, rules, model, "h", None, minute) for c, t, rules, model, minute in rows]
    df = spark.createDataFrame(made, REQ.replace("at timestamp", "m long"))
    return df.withColumn("at", F.timestamp_seconds(946_684_800 + F.col("m") * 60)).drop("m")


def test_session_state_and_expiry(spark):
    """A session that was idle past the watermark starts anew; another one goes on."""
    base = folder()
    parts = [ask(spark, (1, 0, ["a"], "x", 0), (2, 0, ["b"], "x", 0), (2, 1, [], "y", 1)),
             ask(spark, (2, 2, None, "y", 50), (2, 2, ["again"], "z", 50)),  # turn 2 twice: one is left out
             ask(spark, (2, 3, [], "y", 300)), ask(spark, (2, 4, [], None, 301)),
             ask(spark, (1, 1, [], "z", 302), (2, 5, [], None, 302))]
    like = parts[0]

    def start():
        src = streams.read_stream(spark, base + "/in/*", like, max_files=1000)
        return streams.start_to_parquet(streams.session_settings(src, "at", "1 minute", idle_ms=120 * 60_000), base + "/out")

    streams.deliver(parts, base + "/in", start)
    got = {(r["conv_id"], r["turn"]): (r["effective_rules"], r["rebuild"]) for r in spark.read.parquet(base + "/out").collect()}
    assert got[1, 0] == (["a"], False) and got[2, 0] == (["b"], False) and got[2, 1] == (["b"], True)
    assert got[2, 2][0] in (["b"], ["again"])
    assert got[2, 4][1] is True and got[2, 5] == (got[2, 4][0], False)
    assert got[1, 1] == ([], False)  # its state was dropped
    assert len(got) == 8


def test_quantiles_are_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 1.0, None])) for g in ("a", "b", None) for _ in range(rng.randint(40, 90))]
    rows += [("one", 2.5), ("none", None)]
    points = {"lo": 0.0, "mid": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r["g"]: r for r in audit.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", points).collect()}
    for g in ("a", "b", None, "one"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        for n, q in points.items():
            pos = (len(v) - 1) * q
            want = v[math.floor(pos)] + (v[math.ceil(pos)] - v[math.floor(pos)]) * (pos - math.floor(pos))
            assert abs(got[g][n] - want) < 1e-12
    assert "none" not in got


def test_digest_of_a_large_group(spark):
    """A group of 200 MB passes through one task as a stream; small ones beside it keep their keys."""
    part = "é" * 500_000
    big = spark.range(200).select(F.lit("big").alias("collection"), F.col("id").alias("ord"),
                                  F.concat(F.col("id").cast("string"), F.lit(part)).alias("text"))
    small = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("s", 3, None), (None, 1, "n")], "collection string, ord long, text string")
    want = hashlib.md5()
    for i in range(200):
        want.update(f"{i}{part}".encode())
    got = {r[0]: r[1] for r in FP.streamed_md5(big.unionByName(small), "collection", ["ord"], "text").collect()}
    assert got == {"big": want.hexdigest(), "s": hashlib.md5(b"ab").hexdigest(), None: hashlib.md5(b"n").hexdigest()}


def test_session_key_of_many_names(spark):
    n = 120_000
    files = spark.range(n).select(F.lit("c").alias("collection"), F.concat(F.lit("f"), "id").alias("name"))
    got = FP.session_key(files, "m", 10, 2, False, "").first()["session_id"]
    names = "|".join(sorted(f"f{i}" for i in range(n)))
    assert got == hashlib.md5(f"{names}m102False".encode()).hexdigest()[:16]
