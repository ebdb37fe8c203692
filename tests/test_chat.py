"""Question parsing (H7), history (H1/H2), prompts (H4), hosts (H10), k rule (V2)."""

from pyspark.sql import functions as F

from docshield.functions import chat as CH
from docshield.functions import vectors as V
from docshield.operators import chat

DEFAULTS = CH.DEFAULT_QUESTIONS


def _parse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(CH.parse_questions(F.col("t"))).collect()]


def test_parse_json_list(spark):
    assert _parse(spark, ['Sure: ["What is A?", " ", "Why B?", "How C?", "D?"] done']) == \
        [["What is A?", "Why B?", "How C?"]]


def test_parse_bullets_and_quotes(spark):
    # pass 2 compares lines *with* their bullet, so a bulleted question can return once more
    text = '1. What is the scope of work?\n- "Who signs the contract?"\n* short?\nplain line'
    assert _parse(spark, [text]) == [["What is the scope of work?", "Who signs the contract?",
                                      "1. What is the scope of work?"]]


def test_parse_broken_json_falls_back(spark):
    assert _parse(spark, ['["What is the first item here?", "Second']) == [DEFAULTS]


def test_parse_prose_and_empty(spark):
    assert _parse(spark, ["No questions at all.", "", None]) == [DEFAULTS, DEFAULTS, DEFAULTS]


def test_parse_empty_json_then_lines_dedup(spark):
    # an empty JSON list falls through; pass 1 keeps repeats, pass 2 adds nothing new
    text = "Intro\nIs the budget approved yet?\nIs the budget approved yet?\n[]"
    assert _parse(spark, [text]) == [["Is the budget approved yet?", "Is the budget approved yet?"]]


def test_history_roles(spark):
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
                                  (1, 3, "tool", "t"), (1, 4, "user", "u2")],
                                 "conv_id long, turn long, role string, text string")
    api = [(r["turn"], r["hist_role"], r["hist_pos"]) for r in chat.history(conv).orderBy("turn").collect()]
    assert api == [(1, "user", 0), (2, "assistant", 1), (4, "user", 2)]
    cli = [r["hist_role"] for r in chat.history(conv, other_roles="assistant").orderBy("turn").collect()]
    assert cli == ["assistant", "user", "assistant", "assistant", "user"]


def test_has_history_paths_agree(spark, sf):
    from docshield.plans import bindings as B
    from docshield.sources.tables import table
    conv = table(spark, sf, "conversations")
    req = B.requests(conv)
    a = chat.has_history(req, conv).select("conv_id", "turn", "n_history")
    b = chat.has_history(req, conv, requests_are_turns=True).select("conv_id", "turn", "n_history")
    assert sorted(a.collect()) == sorted(b.collect())


def test_prior_messages_and_prompt(spark):
    conv = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2")],
                                 "conv_id long, turn long, role string, text string")
    req = spark.createDataFrame([(1, 2, "q2", "", "ctx")],
                                "conv_id long, turn long, question string, system_prompt string, context string")
    p = chat.prompts(chat.prior_messages(req, conv)).first()["messages"]
    assert [m["role"] for m in p] == ["system", "user", "assistant", "user"]
    assert p[0]["content"].startswith(CH.DEFAULT_SYSTEM_PROMPT) and p[0]["content"].endswith("Context:\nctx")


def test_resolve_host_and_k(spark):
    df = spark.createDataFrame([("", "llama3"), ("https://api.openai.com//", "x"), ("http://h/", "GPT-4o")],
                               "host string, model string")
    got = df.select(CH.resolve_host(F.col("host"), "http://localhost:11434").alias("h"),
                    V.k_for(F.col("host"), F.col("model")).alias("k")).collect()
    assert [(r["h"], r["k"]) for r in got] == [("http://localhost:11434", 4), ("https://api.openai.com", 8),
                                                ("http://h", 8)]


def test_prior_messages_in_blocks(spark):
    """Blocks of any size give the messages before each request, in order."""
    conv = [(s, t, r, f"{s}/{t}") for s in (1, 2) for t, r in enumerate(["system", "user", "assistant", "user", "tool", "assistant"] * (3 * s))]
    df = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    req = spark.createDataFrame([(1, 0), (1, 5), (1, 99), (2, 7), (2, 35), (3, 4)], "conv_id long, turn long")
    for block in (1, 3, 4, 64):
        got = {(r["conv_id"], r["turn"]): [tuple(m) for m in r["history"]] for r in chat.prior_messages(req, df, block=block).collect()}
        assert got == {(s, t): [(r, x) for s2, t2, r, x in conv if s2 == s and t2 < t and r in ("user", "assistant")]
                       for s, t in [(1, 0), (1, 5), (1, 99), (2, 7), (2, 35), (3, 4)]}


def test_hooks_see_history_and_prompt(spark, sf):
    from docshield.plans import bindings as B
    from docshield.plans import turns
    from docshield.sources.tables import table
    conv = table(spark, sf, "conversations")
    docs = table(spark, sf, "documents").select(F.col("source").alias("collection"), "doc_id", "source", "text")
    index = turns.build_index(docs).persist()

    def model():
        return lambda pdf: [f"{len(m)} {m[0]['role']} {m[-1]['content'] == q}" for m, q in zip(pdf["messages"], pdf["question_used"])]

    def rephrase():
        return lambda pdf: [f"{q} {h[0]['content']}" for q, h in zip(pdf["question_used"], pdf["history"])]

    rows = turns.run_turns(B.requests(conv), index, conv, answer_fn=model, reformulate=rephrase, requests_are_turns=True).collect()
    seen = [r for r in rows if r["source"] == "llm"]
    assert seen and all(r["answer"] == f"{r['n_history'] + 2} system True" for r in seen)
