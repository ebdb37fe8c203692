"""What keeps the index build and the search within an executor's memory, and blocks that meet."""

import pytest
from pyspark.sql import functions as F

from docshield.operators import embedding
from docshield.session import bound_batches
from docshield.sources import stores


def test_write_index_computes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    rows = spark.range(0, 400, 1, 4).select(
        F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("collection"),
        F.col("id").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.col("id").cast("string").alias("text"))
    stores.write_index(rows.withColumn("text", seen("text")), str(tmp_path / "index"))
    back = stores.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, back.select("doc_id", "collection", "text").collect())) == \
        sorted(map(tuple, rows.select("doc_id", "collection", "text").collect()))
    assert made.value == 400


def test_token_cache_is_bounded_within_a_call(monkeypatch):
    monkeypatch.setattr(embedding, "_BUCKETS", {})
    monkeypatch.setattr(embedding, "_BUCKET_CACHE_MAX", 50)
    texts = [" ".join(f"w{i}x{j}" for j in range(10)) for i in range(100)]
    m = embedding.hash_counts(texts)
    assert m.sum() == 1000 and len(embedding._BUCKETS[384]) <= 60
    monkeypatch.setattr(embedding, "_BUCKET_CACHE_MAX", 10**6)
    assert (m == embedding.hash_counts(texts)).all()


def test_embedding_of_many_texts_with_nulls(spark):
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"Word{i} word word {i % 11}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r["i"]: r for r in embedding.hashing_embed(df, "t").collect()}
    want = embedding.hash_counts(texts)
    assert all(got[i]["vec"] == want[i].tolist() and got[i]["vec_norm2"] == int((want[i] ** 2).sum()) for i in range(600))


def test_session_batches_are_lowered_but_never_raised(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], "67108864")
        bound_batches(spark)
        assert spark.conf.get(keys[0]) == "2048" and spark.conf.get(keys[1]).rstrip("b") == str(16 << 20)
        spark.conf.set(keys[0], "500")
        bound_batches(spark)
        assert spark.conf.get(keys[0]) == "500"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [(8, 16), (1, 1)])  # with one row a block, some blocks of a side are empty
def test_blocks_meet_when_they_are_dealt_to_many_tasks(spark, monkeypatch, rows):
    from docshield.operators import search
    monkeypatch.setattr(search, "Q_BLOCK_ROWS", rows[0])
    monkeypatch.setattr(search, "I_BLOCK_ROWS", rows[1])

    def side(n, seed):
        vec = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(5)).cast("int"))
        d = spark.range(n).select("id", F.concat(F.lit("c"), F.col("id") % 3).alias("collection"), vec.alias("vec"))
        return d.withColumn("n2", F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x * x))

    def found(strategy):
        hits = search.topk(side(40, 1).withColumnRenamed("vec", "qvec"), side(90, 2).withColumnRenamed("id", "iid"), 4, q_id="id",
                           q_vec="qvec", i_id="iid", i_vec="vec", partition="collection", metric="cosine", q_norm2="n2", i_norm2="n2",
                           strategy=strategy)
        return sorted(map(tuple, hits.collect()))

    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else few rows are put into one task
    try:
        blocks = found("blocks")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(blocks) == 160 and blocks == found("broadcast")


def test_vectors_of_a_hot_collection_are_not_dealt_by_collection(spark):
    from docshield.operators import search
    from docshield.session import cut_lineage
    vec = F.array(*[(F.col("id") % n).cast("int") for n in (2, 3, 5)])
    side = cut_lineage(spark.range(60).select("id", F.when(F.col("id") < 50, "hot").otherwise("c").alias("collection"),
                                              vec.alias("vec"), F.lit(1).cast("bigint").alias("n2")))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large
        hits = search.topk(side.withColumnRenamed("vec", "qvec"), side.withColumnRenamed("id", "iid"), 2, q_id="id", q_vec="qvec",
                           i_id="iid", i_vec="vec", partition="collection", metric="cosine", q_norm2="n2", i_norm2="n2", strategy="blocks")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(_p#" in plan
        assert not [x for x in plan.splitlines() if "hashpartitioning(_p#" in x and "_ib#" not in x and "_q0#" not in x]
        assert hits.count() == 120
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
