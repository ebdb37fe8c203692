"""Index/policy stores (E3, E4, G8) and stream = batch."""

import tempfile

import pytest
from pyspark.sql import functions as F

from docshield.functions import guard as G
from docshield.sources import stores


def test_index_roundtrip_and_missing_key(spark):
    d = tempfile.mkdtemp(prefix="docshield-test-")
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", 2, [3, 4])], "collection string, chunk_id long, vec array<int>")
    stores.write_index(df, d + "/idx")
    stores.write_index(df.where("collection = 'a'").withColumn("chunk_id", F.lit(9).cast("long")), d + "/idx")
    got = sorted((r["collection"], r["chunk_id"]) for r in stores.read_index(spark, d + "/idx").collect())
    assert got == [("a", 9), ("b", 2)]
    assert stores.read_index(spark, d + "/idx", ["b"]).count() == 1
    with pytest.raises(FileNotFoundError):
        stores.read_index(spark, d + "/idx", ["nope"])
    with pytest.raises(FileNotFoundError):
        stores.read_index(spark, d + "/missing", ["a"])


def test_deleted_collections_are_never_read(spark, monkeypatch):
    """Also when the call is cut short between its two steps, and when a collection comes back."""
    path = tempfile.mkdtemp(prefix="docshield-test-") + "/idx"
    df = spark.createDataFrame([("a", 1, 0), ("b x", 2, 0), ("c/d", 3, 0), ("a", 4, 0)], "collection string, doc_id long, epoch int")
    stores.write_index(df, path, ["collection", "epoch"])

    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "collection string")

    def there():
        return sorted((r["collection"], r["doc_id"]) for r in stores.read_index(spark, path).collect())

    def folders():
        from pathlib import Path
        return len(list(Path(path).glob("collection=*")))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(stores, "vacuum", crash)
        with pytest.raises(RuntimeError):
            stores.delete_collections(spark, path, ids("a", "unknown"))
    assert there() == [("b x", 2), ("c/d", 3)] and folders() == 3
    with pytest.raises(FileNotFoundError):
        stores.read_index(spark, path, ["a"])
    with pytest.raises(FileNotFoundError):
        stores.read_index_for(spark, path, ids("a"))
    # what was left of "a" does not come back with a new part of it
    stores.write_index(df.where("doc_id = 4").withColumn("epoch", F.lit(7)), path, ["collection", "epoch"])
    assert there() == [("a", 4), ("b x", 2), ("c/d", 3)]
    stores.delete_collections(spark, path, ids("c/d"))
    assert there() == [("a", 4), ("b x", 2)] and folders() == 2
    n = stores._version(spark, path)
    monkeypatch.setattr(stores, "_version", lambda *_: n - 1)  # a second writer that saw the same state
    with pytest.raises(Exception, match="exist"):
        stores.delete_collections(spark, path, ids("b x"))


def test_policy_store(spark):
    d = tempfile.mkdtemp(prefix="docshield-test-")
    assert stores.load_policy(spark, d + "/none").inputs == G.Policy.default().inputs
    p = G.Policy({"Public": [], "Custom": ["budget"]}, {"Public": [], "Custom": ["budget"]},
                 {"Public": "p", "Custom": "c"}, {"Public": "p", "Custom": "c"})
    stores.save_policy(spark, p, d + "/pol")
    q = stores.load_policy(spark, d + "/pol")
    assert q.inputs == {"Public": [], "Custom": ["budget"]} and q.badges["Custom"] == "c"


def test_streams_equal_batch(spark, sf):
    from docshield.plans.catalog import QUERIES
    a = sorted(QUERIES["t2_stream_guard"](spark, sf).collect())
    b = sorted(QUERIES["g3_input_check"](spark, sf).collect())
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    roll = QUERIES["t3_stream_audit_rollup"](spark, sf)
    from docshield.sources.tables import table
    assert roll.agg(F.sum("n")).first()[0] == table(spark, sf, "events").count()


def test_large_policy_is_kept(spark):
    """100,001 stored rules block as stored; the automaton gives what the expressions give."""
    from docshield.operators import guarding
    d = tempfile.mkdtemp(prefix="docshield-test-")
    rows = spark.range(100_000).select(F.lit("Restricted").alias("tier"), F.lit("in").alias("direction"),
                                       F.col("id").cast("int").alias("ord"), F.concat(F.lit("code name "), "id").alias("pattern"))
    rows = rows.unionByName(spark.createDataFrame([("Restricted", "in", 100_000, "zebra")], rows.schema))
    rows.write.parquet(d + "/pol/patterns")
    spark.createDataFrame([("Restricted", "r", "r"), ("Public", "p", "p")], "tier string, description string, badge string") \
        .write.parquet(d + "/pol/tiers")
    pol = stores.load_policy(spark, d + "/pol")
    assert G.n_patterns(pol) == 100_001
    asked = [("all about code name 77777 and zebras", "Restricted", "code name 7"), ("two zebras.", "Restricted", "zebra"),
             ("zebraic", "Restricted", None), ("zebra", "Public", None), (None, "Restricted", None),
             ("my password", "Elsewhere", "password")]
    df = spark.createDataFrame([(i, q, t, True) for i, (q, t, _) in enumerate(asked)], "i int, question string, tier string, enabled boolean")
    got = guarding.check_input(df, rules=None, policy=pol).orderBy("i").collect()
    assert [r["in_rule"] for r in got] == [w for _, _, w in asked]


def test_automaton_equals_expression(spark):
    texts = ["my API key", "two passwords", "passwordless", "pass_word password_", "credentials' end", "ssn", "ssns", "x ssn1", "", None,
             "the patient's salary", "tax returns", "credit card and bank account", "TRADING floor", "éssn ssné"]
    tiers = ["Public", "Internal", "Confidential", "Restricted", "Nowhere"]
    df = spark.createDataFrame([(q, t) for q in texts for t in tiers], "q string, tier string")
    pol = G.Policy.default()
    for way in ("in", "out"):
        both = df.select(G.tier_hit(F.col("q"), F.col("tier"), pol, way).alias("a"),
                         G.tier_hit_udf(pol, way)(F.lower("q"), F.col("tier")).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in both)


def test_small_and_large_policies_name_the_same_rule(spark):
    """Capitals, blanks around a pattern, combining marks and odd word characters; 24 and 100,001 patterns."""
    from docshield.operators import guarding
    own = [" Pass Word ", "ZEBRA", "zebra", "  ", "C++", "Été", "fish\t", "x_y"]
    marks = ["\u0301", "\u200d", "²", "Ⅷ", "ⓑ", "_", "٣", "é", "ß", "-", "'", "🙂", "字", "\u0488", "\u00aa"]
    texts = ["my pass word", "two zebras", "Zebra", "c++ code", "l'été", "fish", "x_yz", "fishs!", None, ""]
    texts += [f"a zebra{m} b" for m in marks] + [f"a {m}fish b" for m in marks] + [f"fishs{m}" for m in marks]
    df = spark.createDataFrame([(i, t, "Own", True) for i, t in enumerate(texts)], "i int, question string, tier string, enabled boolean")
    got = []
    for more in (16, 99_993):
        pol = G.Policy({"Own": own + [f"code name {i}" for i in range(more)]}, {}, {"Own": "o"}, {"Own": "o"})
        batch = guarding.check_input(df, rules=None, policy=pol).orderBy("i")
        got.append([(r["in_rule"], r["in_message"]) for r in batch.collect()])
        rules = guarding.tier_hits(df, "question", "tier", pol, "in").orderBy("i").collect()
        assert [r["rule"] for r in rules] == [r for r, _ in got[-1]]
    assert got[0] == got[1]
    assert [r for r, _ in got[0]][:6] == [" Pass Word ", "ZEBRA", "ZEBRA", "C++", "Été", "fish\t"]
    from docshield.streaming import streams
    large = df.withColumn("custom_rules", F.array().cast("array<string>"))
    assert [r["rule"] for r in streams.stream_guard(large, pol).orderBy("i").collect()] == [r for r, _ in got[1]]


def test_policy_errors_are_raised(spark):
    class Denied:
        @property
        def read(self):
            raise PermissionError("denied")

    with pytest.raises(PermissionError):
        stores.load_policy(Denied(), "/any")
    d = tempfile.mkdtemp(prefix="docshield-test-")
    with pytest.warns(UserWarning):
        assert stores.load_policy(spark, d + "/none").inputs == G.Policy.default().inputs


def test_redelivered_documents_are_indexed_once(spark, sf):
    from docshield.plans.catalog import QUERIES
    idx = QUERIES["t1_stream_ingest"](spark, sf)
    assert idx.count() == idx.distinct().count() == idx.select("collection", "chunk_id").distinct().count()


def test_checkpoint_folder_is_not_made_up_on_a_cluster(monkeypatch):
    from docshield import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
