"""Composite keys: equal ids in different collections never meet."""

from pyspark.sql import functions as F

from docshield.functions import guard as G
from docshield.plans import turns
from docshield.sources import documents, stores
from docshield.operators import guarding

BIG = 10 ** 15  # beyond any stride that packs two keys into one number


def test_no_foreign_citation(spark, tmp_path):
    docs = [("a", 1, "one.txt", "apples and pears"), ("b", 1, "one.txt", "bridges and towers"),
            ("a", BIG, "two.txt", "apples " * 400), ("b", BIG, "two.txt", "bridges " * 400)]
    index = turns.build_index(spark.createDataFrame(docs, "collection string, doc_id long, source string, text string"), 1000, 200)
    stores.write_index(index, str(tmp_path / "index"))
    index = stores.read_index(spark, str(tmp_path / "index"))
    ask = [(c, t, f"which {w}", "Public", True, [], "m", "", c2) for c, t, w, c2 in
           ((1, 0, "apples", "a"), (1, BIG, "bridges", "a"), (BIG, 0, "bridges", "b"), (BIG, BIG, "apples", "b"))]
    ask = [(BIG + 3 if c == BIG else c, *rest) for c, *rest in ask]
    req = spark.createDataFrame(ask, "conv_id long, turn long, question string, tier string, enabled boolean, "
                                     "custom_rules array<string>, model string, host string, collection string")
    conv = req.select("conv_id", "turn", F.lit("user").alias("role"), F.col("question").alias("text"))
    rows = turns.run_turns(req, index, conv, requests_are_turns=True).collect()
    assert len(rows) == 4
    own = {"a": "apples", "b": "bridges"}
    for r in rows:
        assert r["citations"] and all(own[r["collection"]] in c["text"] for c in r["citations"])
        assert len({c["id"] for c in r["citations"]}) == len(r["citations"]) <= r["k"]


def test_file_names_with_spaces(spark, tmp_path):
    for name in ("my report.txt", "a+b %20.txt", ".pdf", "plain.TXT"):
        (tmp_path / name).write_text(name)
    got = {r["text"]: (r["source"], r["ext"]) for r in documents.read_documents(spark, str(tmp_path / "[amp]*")).collect()}
    assert got == {"my report.txt": ("my report.txt", ".txt"), "a+b %20.txt": ("a+b %20.txt", ".txt"), "plain.TXT": ("plain.TXT", ".txt")}
    names = spark.createDataFrame([(".pdf",), ("a.b.DOCX",), ("none",)], "n string")
    assert [r[0] for r in names.select(documents.extension(F.col("n"))).collect()] == ["", ".docx", ""]


def test_rules_lose_white_space_of_all_kinds(spark):
    df = spark.createDataFrame([("my password", ["\tpassword\n"]), ("my password", [" "]), ("x", [" "])], "q string, rules array<string>")
    got = [r[0] for r in df.select(G.custom_hit(F.col("q"), F.col("rules"))).collect()]
    assert got == ["\tpassword\n", None, None]


def test_edit_replaces_a_tier(spark):
    rows = guarding.policy_rows(spark)
    edits = spark.createDataFrame([("Restricted", "in", 0, "x")], rows.schema)
    got = guarding.upsert_tier(rows, edits).where("tier = 'Restricted'").collect()
    assert [tuple(r) for r in got] == [("Restricted", "in", 0, "x")]
