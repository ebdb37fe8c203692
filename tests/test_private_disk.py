"""What tokenising moves: the rows that hold an entity, not the others."""

def test_texts_without_entities_are_not_shuffled(spark):
    """Tokenised texts are those of the rows' own spans; the others do not reach the join."""
    from docshield.operators import redaction
    rows = [("a" if n % 3 else None, n, f"text {n}" + (f" mail x{n}@example.com" if n % 50 == 0 else "")) for n in range(1000)]
    docs = spark.createDataFrame(rows, "collection string, doc_id long, text string")
    made, mapping = redaction.tokenize_pii(docs)
    got = {r["doc_id"]: r["text_tokens"] for r in made.collect()}
    assert len(got) == 1000 and made.columns == ["collection", "doc_id", "text", "text_tokens"]
    tokens = {(r["collection"], r["original"]): r["token"] for r in mapping.collect()}
    for c, n, text in rows:
        want = text if n % 50 or c is None else text.replace(f"x{n}@example.com", tokens[c, f"x{n}@example.com"])
        assert got[n] == want
    marked = redaction.mark_matches(docs, docs.where("doc_id % 50 = 0"), ["collection", "doc_id"], "held")
    assert marked.where("held").count() < 40
