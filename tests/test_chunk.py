"""Chunking invariants (C1), the window form (C1b) and their agreement on whitespace-free text."""

from pyspark.sql import functions as F

from docshield.operators import chunking


def _check_invariants(text, chunks, size, overlap):
    pos = 0
    for c in chunks:
        assert 0 < len(c) <= size
        assert c == c.strip()
        i = text.find(c, max(0, pos - size))
        assert i >= 0, "every chunk is a substring, in order"
        pos = i + len(c)
    covered = set()
    start = 0
    for c in chunks:
        i = text.find(c, start)
        covered.update(range(i, i + len(c)))
        start = max(start, i + len(c) - overlap - 1)
    for j, ch in enumerate(text):
        if not ch.isspace():
            assert j in covered, "every non-space character is in some chunk"


def test_split_text_invariants(spark, sf):
    from docshield.sources.tables import table
    texts = [r[0] for r in table(spark, sf, "documents").select("text").limit(60).collect()]
    for t in texts:
        for size, overlap in ((1000, 200), (300, 50)):
            _check_invariants(t, chunking.split_text(t, size, overlap), size, overlap)


def test_split_text_small_examples():
    assert chunking.split_text("", 10, 2) == []
    assert chunking.split_text("abc", 10, 2) == ["abc"]
    out = chunking.split_text("one two three four five six", 10, 4)
    assert all(len(c) <= 10 for c in out) and out[0] == "one two"


def test_spark_chunk_equals_python(spark, sf):
    from docshield.sources.tables import table
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = {}
    for r in chunking.chunk(docs, "text", 500, 100).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_idx"], r["chunk_text"]))
    for r in docs.collect():
        want = chunking.split_text(r["text"], 500, 100)
        assert [c for _, c in sorted(got.get(r["doc_id"], []))] == want


def test_windows_equal_recursive_on_whitespace_free_text(spark, sf):
    from docshield.sources.tables import table
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\s", "").alias("text"))
    win = {(r["doc_id"], r["chunk_idx"]): r["chunk_text"]
           for r in chunking.chunk_windows(docs, "text", 300, 60).collect()}
    for r in docs.collect():
        rec = chunking.split_text(r["text"], 300, 60)
        assert rec == [win[(r["doc_id"], i)] for i in range(len(rec))]
        n = 0 if not r["text"] else 1 + max(0, -(-(len(r["text"]) - 300) // 240))
        assert len(rec) == n
