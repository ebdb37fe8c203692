"""Sources (S2, S3, S5), profiles (G13, G14), audit events (A1), stream ingest."""

import pytest
from pyspark.sql import functions as F

from docshield.operators import audit, guarding
from docshield.sources import documents as SD


def _files(spark):
    return spark.createDataFrame([("a.TXT",), ("b.pdf",), ("c.md",), ("noext",)], "name string")


def test_split_supported_modes(spark):
    assert sorted(r[0] for r in SD.split_supported(_files(spark), "skip").collect()) == ["a.TXT", "b.pdf"]
    with pytest.raises(ValueError):
        SD.split_supported(_files(spark), "fail")
    assert SD.split_supported(_files(spark).where("name <> 'c.md' AND name <> 'noext'"), "fail").count() == 2


def test_dedup_incoming_first_wins(spark):
    ex = spark.createDataFrame([("x.txt", 1)], "name string, v int")
    inc = spark.createDataFrame([("x.txt", 2), ("y.txt", 3), ("y.txt", 4)], "name string, v int")
    got = sorted(tuple(r) for r in SD.dedup_incoming(ex, inc).collect())
    assert got == [("x.txt", 1), ("y.txt", 3), ("y.txt", 4)]


def test_assert_non_empty(spark):
    with pytest.raises(ValueError):
        SD.assert_non_empty(spark.createDataFrame([], "t string"))


def test_read_documents_folder(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Hello\nworld", encoding="utf-8")
    (tmp_path / "two.txt").write_text("Bonjour réseau", encoding="utf-8")
    rows = {r["source"]: r["text"] for r in SD.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"one.txt": "Hello\nworld", "two.txt": "Bonjour réseau"}


def test_match_and_merge_profiles(spark):
    prof = guarding.ui_profiles(spark)
    st = spark.createDataFrame([(1, 1000, 200, "Internal", True), (2, 600, 100, "Public", True),
                                (3, 600, 100, "Public", False)],
                               "id int, chunk_size int, chunk_overlap int, sensitivity string, guardrails boolean")
    got = {r["id"]: r["profile"] for r in guarding.match_profile(st, prof).collect()}
    assert got == {1: "Balanced (Default)", 2: "Fast Summarizer", 3: None}
    custom = prof.where("key = 'fast'").withColumn("chunk_size", F.lit(700))
    merged = {r["key"]: r["chunk_size"] for r in guarding.merge_profiles(prof, custom).collect()}
    assert merged == {"balanced": 1000, "strict": 1000, "fast": 700}


def test_turn_events(spark):
    rows = [(1, 1, "input_guard", "Internal", "q1", 0), (1, 2, "output_guard", "Public", "q2", 0),
            (1, 3, "llm", "Public", "q3", 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, source string, tier string, question string, n_citations int")
    ev = {r["turn"]: r for r in audit.turn_events(df, redacted=True).collect() if r["event_type"] != "redaction"}
    assert ev[1]["message"] == "Input question blocked by Internal policy."
    assert ev[2]["message"] == "LLM output blocked and redacted under Public policy."
    assert ev[3]["event_type"] == "retrieval" and ev[3]["details"]["citations_count"] == "4"
    red = [r for r in audit.turn_events(df, redacted=True).collect() if r["event_type"] == "redaction"]
    assert sorted(r["turn"] for r in red) == [2, 3]


def test_stream_ingest_equals_batch_index(spark, sf):
    from docshield.plans.catalog import QUERIES, _index
    streamed = sorted(tuple(r) for r in QUERIES["t1_stream_ingest"](spark, sf).collect())
    batch = sorted(tuple(r) for r in _index(spark, sf).select("chunk_id", "collection",
                                                              F.col("vec_norm2").cast("bigint")).collect())
    assert streamed == batch
