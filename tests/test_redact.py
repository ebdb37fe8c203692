"""Redaction examples (FIXTURES §2), token maps and manual words."""

import re

from pyspark.sql import functions as F

from docshield.functions import redact as R
from docshield.operators import redaction


def _red(spark, text, names=False):
    return spark.createDataFrame([(text,)], "t string").select(R.redact(F.col("t"), names)).first()[0]


def test_email(spark):
    out = _red(spark, "Contact me at john.doe@example.com for details.")
    assert "john.doe@example.com" not in out and "[EMAIL_REDACTED]" in out


def test_phone(spark):
    out = _red(spark, "My phone number is 123-456-7890 or +1 (555) 019-2834.")
    assert "123-456-7890" not in out and "555" not in out and "[PHONE_REDACTED]" in out


def test_ssn(spark):
    out = _red(spark, "Social security code: 000-12-3456.")
    assert "000-12-3456" not in out and "[SSN_REDACTED]" in out


def test_card(spark):
    out = _red(spark, "Visa card: 1111-2222-3333-4444.")
    assert "1111-2222-3333-4444" not in out and "[CREDIT_CARD_REDACTED]" in out


def test_credential(spark):
    out = _red(spark, "Secret key: sk-abcdefghijklmnopqrstuvwxyz0123456789ABCDabcd.")
    assert "sk-abcdef" not in out and "[CREDENTIAL_REDACTED]" in out


def test_names_on(spark):
    out = _red(spark, "Mr. John Smith visited Dr. Alice last Tuesday. John went to the market.", names=True)
    assert "John Smith" not in out and "Alice" not in out and "[NAME_REDACTED]" in out


def test_names_off(spark):
    out = _red(spark, "John Smith visited Dr. Alice last Tuesday. Email: test@example.com")
    assert "John Smith" in out and "Dr. Alice" in out and "[EMAIL_REDACTED]" in out


def test_guards_do_not_change_results(spark, sf):
    from docshield.sources.tables import table
    docs = table(spark, sf, "documents")
    guarded = docs.select("doc_id", R.redact(F.col("text")).alias("a"))
    plain = docs.select("doc_id", F.col("text").alias("a"))
    for t in R.PII_TYPES:  # the same chain without the guards
        for _ in range(t.passes):
            plain = plain.withColumn("a", F.regexp_replace("a", t.regex, R._java_repl(t, t.placeholder)))
    assert sorted(guarded.collect()) == sorted(plain.collect())


def test_tokenize_rehydrate_roundtrip(spark):
    rows = [("c1", 1, "mail a@x.org or call 123-456-7890"), ("c1", 2, "again a@x.org and b@y.net"),
            ("c2", 1, "other a@x.org"), ("c2", 2, "nothing here")]
    df = spark.createDataFrame(rows, "collection string, doc_id long, text string")
    tok, mp = redaction.tokenize_pii(df)
    m = {(r["collection"], r["original"]): r["token"] for r in mp.collect()}
    assert m[("c1", "a@x.org")] == "[EMAIL_1]" and m[("c1", "b@y.net")] == "[EMAIL_2]"
    assert m[("c2", "a@x.org")] == "[EMAIL_1]" and m[("c1", "123-456-7890")] == "[PHONE_1]"
    back = redaction.rehydrate(tok, mp, "collection", "doc_id", "text_tokens", "back")
    for r in back.collect():
        assert r["back"] == r["text"]
        assert "a@x.org" not in r["text_tokens"]


def test_extend_map_continues_numbering(spark):
    old = spark.createDataFrame([("c1", "EMAIL", "[EMAIL_1]", "a@x.org", 1)],
                                "collection string, entity_type string, token string, original string, ord long")
    q = spark.createDataFrame([("c1", 9, "ask a@x.org and z@z.io")], "collection string, doc_id long, text string")
    new = redaction.extend_map(old, q, "collection", "doc_id", "text").collect()
    assert [(r["token"], r["original"]) for r in new] == [("[EMAIL_2]", "z@z.io")]


def _py_manual(text, words):
    for w in words:
        if w:
            text = re.sub(r"\b" + re.escape(w) + r"\b", "[MANUAL_REDACTED]", text, flags=re.IGNORECASE)
    return text


def test_manual_words_match_python_re(spark):
    texts = ["The theme of the THE", "C++ and C++x", "acme, Acme. ACME!", "réseau seau"]
    words = ["the", "C++", "", "acme", "seau"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(R.redact_words(F.col("t"), words)).collect()]
    assert got == [_py_manual(t, words) for t in texts]


def test_parse_words(spark):
    df = spark.createDataFrame([(" a, b ,, c ,",)], "s string")
    assert df.select(R.parse_words(F.col("s"))).first()[0] == ["a", "b", "c"]


def _tokenised(spark, texts, **more):
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "collection string, doc_id long, text string")
    tok, mp = redaction.tokenize_pii(df, **more)
    back = redaction.rehydrate(tok, mp, "collection", "doc_id", "text_tokens", "back")
    rows = {r["doc_id"]: r for r in back.collect()}
    assert all((rows[i]["back"] or "") == (t or "") for i, t in enumerate(texts))
    return [rows[i]["text_tokens"] for i in range(len(texts))], {r["token"]: r["original"] for r in mp.collect()}


def test_adjacent_values_all_go(spark):
    got, _ = _tokenised(spark, ["123-456-7890 123-456-7891", "000-12-3456,000-12-3457,000-12-3458", "a@b.io;c@d.io"])
    assert got == ["[PHONE_1] [PHONE_2]", "[SSN_1],[SSN_2],[SSN_3]", "[EMAIL_1];[EMAIL_2]"]


def test_no_value_inside_another(spark):
    secret = 'token = "a1234567890b1234567890c1234567890d12345"'
    got, mp = _tokenised(spark, [secret + " call 555-123-4567", "1111-2222-3333-4444"])
    assert got == ["[CREDENTIAL_1] call [PHONE_1]", "[CREDIT_CARD_1]"] and mp["[PHONE_1]"] == "555-123-4567"


def test_replaced_where_found(spark):
    got, _ = _tokenised(spark, ["1234567890 but 991234567890123 stays", "x 1234567890"])
    assert got == ["[PHONE_1] but 991234567890123 stays", "x [PHONE_1]"]


def test_literal_tokens_come_back_as_they_were(spark):
    got, mp = _tokenised(spark, ["the sign [PHONE_1] is text", "call 555-123-4567", None, ""])
    assert got[0] == "the sign [LITERAL_1] is text" and got[1] == "call [PHONE_1]" and mp["[LITERAL_1]"] == "[PHONE_1]"


def test_names_are_tokens(spark):
    texts = ["Mr. John Smith met Dr. Alice", "Dr. Alice left"]
    got, _ = _tokenised(spark, texts)
    assert got == ["[NAME_1] met [NAME_2]", "[NAME_2] left"]
    assert _tokenised(spark, texts, names=False)[0] == texts


def test_profile_counts_spans(spark):
    df = spark.createDataFrame([("a", "123-456-7890 123-456-7891"), ("a", 'token = "a1234567890b1234567890c1234567890d"'), ("b", None)],
                               "source string, text string")
    rows = {r["source"]: r for r in redaction.pii_profile(df, ["source"]).collect()}
    assert rows["a"]["n_phone"] == 2 and rows["a"]["n_credential"] == 1 and rows["b"]["n_phone"] == 0
