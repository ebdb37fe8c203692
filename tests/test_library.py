"""Library (L1-L6), audit (A2-A4) and session info (FIXTURES §3)."""

import datetime as dt

from pyspark.sql import functions as F

from docshield.operators import audit, library


def test_session_info_defaults(spark):
    s = spark.createDataFrame(
        [("test_sess_123", "db_xyz", ["doc1.pdf", "doc2.txt"], "gemma3:1b", "Confidential", False,
          "Test assistant rules", "http://ollama-server:11434", ["rule1", "rule2"]),
         ("bare", "db_1", None, None, None, None, None, None, None)],
        "session_id string, db_id string, files array<string>, model string, sensitivity_level string, "
        "enable_guardrails boolean, system_prompt string, ollama_host string, custom_rules array<string>")
    rows = {r["session_id"]: r for r in library.session_info(s).collect()}
    a = rows["test_sess_123"]
    assert a["files"] == ["doc1.pdf", "doc2.txt"] and a["enable_guardrails"] is False
    assert a["custom_rules"] == ["rule1", "rule2"] and a["ollama_host"] == "http://ollama-server:11434"
    b = rows["bare"]
    assert (b["model"], b["sensitivity_level"], b["enable_guardrails"], b["system_prompt"], b["files"]) == \
        ("gemma3:1b", "Internal", True, "", [])


def test_register_last_write_wins(spark):
    t = dt.datetime
    lib = spark.createDataFrame([("k", t(2024, 1, 1), "m1")], "db_id string, created_at timestamp, model string")
    new = spark.createDataFrame([("k", t(2024, 2, 1), "m2"), ("j", t(2024, 1, 5), "m3")],
                                "db_id string, created_at timestamp, model string")
    got = {r["db_id"]: r["model"] for r in library.register(lib, new).collect()}
    assert got == {"k": "m2", "j": "m3"}


def test_list_resolve_delete(spark):
    lib = spark.createDataFrame([("a", "m"), ("b", None)], "db_id string, model string")
    idx = spark.createDataFrame([("a",)], "db_id string")
    lst = {r["db_id"]: r for r in library.list_library(lib, idx).collect()}
    assert lst["a"]["available"] and not lst["b"]["available"] and lst["b"]["model"] == "unknown"
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "db_id string")
    st = {r["db_id"]: r["status"] for r in library.resolve(req, lib, idx).collect()}
    assert st == {"a": "ok", "b": "index_missing", "c": "not_in_library"}
    lib2, idx2, unknown = library.delete(lib, idx, spark.createDataFrame([("a",), ("zz",)], "db_id string"))
    assert [r[0] for r in lib2.collect()] == ["b"] and idx2.count() == 0 and [r[0] for r in unknown.collect()] == ["zz"]


def test_display_names(spark):
    rows = [("c", i, f"file_{i}.txt") for i in range(5)] + [("d", 0, "only.pdf")]
    f = spark.createDataFrame(rows, "collection string, ord long, name string")
    got = {r["collection"]: r for r in library.display_names(f).collect()}
    assert got["c"]["active_name"] == "file_0.txt (+4 more)"
    joined = ", ".join(f"file_{i}.txt" for i in range(5))
    assert got["c"]["card_name"] == joined[:34] + "…"
    assert got["d"]["active_name"] == "only.pdf" and got["d"]["card_name"] == "only.pdf"


def test_retain_and_view(spark, sf):
    from docshield.sources.tables import table
    ev = table(spark, sf, "events")
    top = audit.retain(ev, 200).collect()
    assert len(top) == 200
    newest = ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).first()
    assert top[0]["event_id"] == newest["event_id"]
    v = audit.audit_view(ev).select("time", "type").first()
    assert len(v["time"]) == 8 and v["type"] == v["type"].upper()


def test_display_names_of_empty_names(spark):
    """Many empty names before a long one: the cut counts their separators."""
    names = [("g", i, "") for i in range(15)] + [("g", 15, "a-name"), ("g", 16, None), ("g", 17, "tail")]
    df = spark.createDataFrame(names, "collection string, ord int, name string")
    want = ", ".join(n or "" for _, _, n in names)
    got = library.display_names(df).first()
    assert got["card_name"] == want[:library.DISPLAY_CUT] + library.ELLIPSIS and got["n_files"] == 18
