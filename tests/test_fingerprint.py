"""Collection keys and session ids against Python's hashlib."""

import hashlib

from docshield.operators import fingerprint as FP


def _files(spark):
    rows = [("c1", 0, "a.txt", "alpha"), ("c1", 1, "b.pdf", "beta"), ("c1", 7, "c.txt", "gamma"),
            ("c2", 3, "z.docx", "zeta")]
    return spark.createDataFrame(rows, "collection string, ord long, name string, text string")


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_exact_key(spark):
    got = {r[0]: r[1] for r in FP.collection_key_exact(_files(spark), 1000, 200, False).collect()}
    assert got["c1"] == _md5("alphabetagamma") + "_1000_200_Raw_Offline"
    assert got["c2"] == _md5("zeta") + "_1000_200_Raw_Offline"


def test_merkle_small_fanout(spark):
    got = {r[0]: r[1] for r in FP.merkle_digest(_files(spark), fanout=2, levels=3).collect()}
    leaves = {0: _md5("alpha"), 1: _md5("beta"), 7: _md5("gamma")}
    l1 = {0: _md5(leaves[0] + leaves[1]), 3: _md5(leaves[7])}
    l2 = {0: _md5(l1[0]), 1: _md5(l1[3])}
    l3 = {0: _md5(l2[0] + l2[1])}
    assert got["c1"] == l3[0]


def test_session_key(spark):
    got = {r[0]: r[1] for r in FP.session_key(_files(spark), "gemma3:1b", 1000, 200, True, "acme").collect()}
    assert got["c1"] == _md5("a.txt|b.pdf|c.txt" + "gemma3:1b" + "1000" + "200" + "True" + "acme")[:16]


def test_reload_key(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("db", "m", "http://h")], "d string, m string, h string")
    got = df.select(FP.reload_session_key(F.col("d"), F.col("m"), F.col("h"))).first()[0]
    assert got == _md5("dbmhttp://h")[:16]


def test_pending(spark):
    new = spark.createDataFrame([("k1",), ("k2",)], "db_id string")
    idx = spark.createDataFrame([("k2",)], "db_id string")
    build, there = FP.pending(new, idx)
    assert [r[0] for r in build.collect()] == ["k1"] and [r[0] for r in there.collect()] == ["k2"]
