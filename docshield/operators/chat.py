"""Conversation operators.

History positions come from ``ordinal_in_groups`` (a hot session is split over tasks);
message arrays for prompts are built per request from the session's earlier turns.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docshield.functions import chat as C
from docshield.operators.ordinal import ordinal_in_groups


def history(conversations: DataFrame, other_roles: str = "drop", session: str = "conv_id",
            seq: str = "turn", group_max: int | None = None) -> DataFrame:
    """H1 long form: kept messages with ``hist_role`` and ``hist_pos`` (0-based, in order).

    ``other_roles='drop'`` keeps user and assistant only (API rule); ``'assistant'`` maps
    every non-user role to assistant (CLI rule).
    """
    if other_roles == "drop":
        kept = conversations.where(F.col("role").isin("user", "assistant")) \
            .withColumn("hist_role", F.col("role"))
    else:
        kept = conversations.withColumn(
            "hist_role", F.when(F.col("role") == "user", "user").otherwise("assistant"))
    numbered = ordinal_in_groups(kept, [session], [seq], out="_o", group_max=group_max)
    return numbered.withColumn("hist_pos", (F.col("_o") - 1).cast("bigint")).drop("_o")


#: Messages of a session that are gathered in one row.
HISTORY_BLOCK = 64


def prior_messages(requests: DataFrame, conversations: DataFrame, session: str = "conv_id",
                   seq: str = "turn", block: int = HISTORY_BLOCK) -> DataFrame:
    """Messages before each request turn as ``history`` array<struct<role,content>>, in order.

    A prompt carries the whole earlier session, so the output grows with session length squared; the
    work does not pass through one task a session: messages are gathered in blocks of ``block``, a
    request takes the blocks before its place (found by (session, block)), cuts the last one and puts
    them together, one row a request."""
    h = history(conversations, session=session, seq=seq)
    blocks = (h.groupBy(session, F.floor(F.col("hist_pos") / block).alias("_b"))
              .agg(F.array_sort(F.collect_list(F.struct("hist_pos", F.struct(F.col("hist_role").alias("role"),
                                                                              F.col("text").alias("content")).alias("m")))).alias("_ms"))
              .select(session, "_b", F.col("_ms.m").alias("_ms")))
    marks = has_history(requests.select(session, seq).distinct(), conversations, session, seq).withColumnRenamed("n_history", "_n")
    parts = marks.where(F.col("_n") > 0).select(
        session, seq, "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block))).alias("_b"))
    met = parts.join(blocks, [session, "_b"]).select(
        session, seq, F.struct("_b", F.slice("_ms", 1, F.least(F.lit(block), F.col("_n") - F.col("_b") * block).cast("int")).alias("ms")).alias("p"))
    whole = met.groupBy(session, seq).agg(F.flatten(F.array_sort(F.collect_list("p"))["ms"]).alias("history"))
    return requests.join(whole, [session, seq], "left").withColumn(
        "history", F.coalesce("history", F.array().cast(whole.schema["history"].dataType)))


def has_history(requests: DataFrame, conversations: DataFrame, session: str = "conv_id",
                seq: str = "turn", requests_are_turns: bool = False) -> DataFrame:
    """Adds ``n_history`` = kept messages before each request turn, in O(rows).

    Requests and kept messages are numbered together by (turn, requests first) and the
    requests alone; the difference of the two ordinals is the count of earlier messages.
    No (request, message) pairs are formed and a hot session is split over tasks.
    """
    from docshield.operators.ordinal import max_group_rows
    # One sizing job: every group below is a subset of (session turns + requests).
    m = max_group_rows(conversations, [session]) * 2
    if requests_are_turns:
        # each request is a kept (user) message of the session: its position is the count
        pos = history(conversations, session=session, seq=seq, group_max=m).select(
            session, seq, F.col("hist_pos").alias("n_history"))
        return requests.join(pos, [session, seq], "left").withColumn(
            "n_history", F.coalesce(F.col("n_history"), F.lit(0)).cast("bigint"))
    h = history(conversations, session=session, seq=seq, group_max=m).select(
        session, seq, F.lit(1).alias("_kind"))
    r = requests.select(session, seq).distinct().withColumn("_kind", F.lit(0))
    both = ordinal_in_groups(h.unionByName(r), [session], [seq, "_kind"], out="_ou", group_max=m)
    req = ordinal_in_groups(r, [session], [seq], out="_or", group_max=m)
    cnt = (both.where(F.col("_kind") == 0).select(session, seq, "_ou")
           .join(req.select(session, seq, "_or"), [session, seq])
           .select(session, seq, (F.col("_ou") - F.col("_or")).cast("bigint").alias("n_history")))
    return requests.join(cnt, [session, seq], "left").withColumn(
        "n_history", F.coalesce(F.col("n_history"), F.lit(0)).cast("bigint"))


def retrieval_query(df: DataFrame, question: str = "question", n_history: str = "n_history",
                    reformulate: Callable | None = None, out: str = "retrieval_query") -> DataFrame:
    """H2: first turn -> raw question; later turns -> reformulated question.

    The batch function only sees rows that need it (rows are split before it runs; a CASE
    would not stop a Python function from seeing every row)."""
    if reformulate is None:
        return df.withColumn(out, F.col(question)).withColumn("reformulated", F.col(n_history) > 0)
    first = df.where(F.col(n_history) == 0).withColumn(out, F.col(question)) \
        .withColumn("reformulated", F.lit(False))
    later = df.where(F.col(n_history) > 0)
    # a copy: a frame's own schema must not change
    schema = StructType(list(later.schema.fields)).add(out, "string").add("reformulated", "boolean")

    def run(batches):
        fn = reformulate()
        for pdf in batches:
            pdf[out] = fn(pdf)
            pdf["reformulated"] = True
            yield pdf

    return first.unionByName(later.mapInPandas(run, schema))


def context(hits: DataFrame, key: list[str], rank: str = "rank", source: str = "source",
            text: str = "chunk_text") -> DataFrame:
    """H3: per request, hits rendered and joined in rank order by a blank line (<= k rows)."""
    return (hits.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"),
                                                      C.render_hit(F.col(source), F.col(text)).alias("s"))))
                 .alias("_h"))
            .select(*key, F.array_join(F.transform("_h", lambda x: x["s"]), C.HIT_SEPARATOR).alias("context")))


def prompts(df: DataFrame, system_prompt: str = "system_prompt", ctx: str = "context",
            hist: str = "history", question: str = "question") -> DataFrame:
    """H4: messages = system (custom or default + context), history, then the question."""
    sys_msg = F.struct(F.lit("system").alias("role"),
                       F.concat(C.system_text(F.col(system_prompt)), F.lit(C.CONTEXT_HEADER),
                                F.coalesce(F.col(ctx), F.lit(""))).alias("content"))
    human = F.struct(F.lit("user").alias("role"), F.col(question).alias("content"))
    return df.withColumn("messages", F.concat(F.array(sys_msg), F.col(hist), F.array(human)))


def answer(df: DataFrame, fn: Callable | None = None, question: str = "question", texts: str = "texts",
           out: str = "answer") -> DataFrame:
    """default = the best-scoring sentence of the hits' texts; ``fn`` = factory of a batch model
    function (called once per partition; receives a pandas frame with ``messages``)."""
    if fn is None:
        return df.withColumn(out, C.best_sentence(F.col(question), F.col(texts)))
    schema = StructType(list(df.schema.fields)).add(out, "string")

    def run(batches):
        model = fn()
        for pdf in batches:
            pdf[out] = pd.Series(model(pdf), index=pdf.index).astype(object)
            yield pdf

    return df.mapInPandas(run, schema)


def new_turns(conversations: DataFrame, responses: DataFrame, session: str = "conv_id") -> DataFrame:
    """H5: per response not blocked at input, a user row (tokenised question), then an assistant row
    (answer or block message); turns continue after the session's last turn.  Only the new rows."""
    last = conversations.groupBy(session).agg(F.max("turn").alias("_last"))
    r = responses.where(F.col("source") != "input_guard")
    r = ordinal_in_groups(r, [session], ["turn"], out="_i").withColumn("_i", F.col("_i") - 1)
    rows = r.join(last, session, "left").select(
        session, F.coalesce(F.col("_last"), F.lit(-1)).alias("_last"), "_i",
        F.explode(F.array(
            F.struct(F.lit(0).alias("o"), F.lit("user").alias("role"), F.col("question_used").alias("text")),
            F.struct(F.lit(1).alias("o"), F.lit("assistant").alias("role"), F.col("stored_answer").alias("text")),
        )).alias("m"))
    return rows.select(session, (F.col("_last") + 1 + F.col("_i") * 2 + F.col("m.o")).cast("long").alias("turn"),
                       F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def append_turns(conversations: DataFrame, responses: DataFrame, session: str = "conv_id") -> DataFrame:
    """H5: the sessions with their new turns."""
    return conversations.unionByName(new_turns(conversations, responses, session))


def clear(conversations: DataFrame, ids: DataFrame, session: str = "conv_id") -> DataFrame:
    """H6: drop every message of the given sessions; unknown ids are ignored."""
    return conversations.join(ids.select(session).distinct(), session, "left_anti")


def setting_changes(requests: DataFrame, session: str = "conv_id", seq: str = "turn",
                    cols=("model", "host", "system_prompt")) -> DataFrame:
    """H9: ``rebuild`` = some setting differs (null-safe) from the session's previous request.
    The previous request comes from an equi-join on (session, ordinal - 1), not a window."""
    from docshield.operators.ordinal import previous_row
    j = previous_row(requests, [session], [seq], list(cols) + [seq], prefix="_prev_")
    changed = None
    for c in cols:
        d = F.col("_prev_" + seq).isNotNull() & ~F.col(c).eqNullSafe(F.col("_prev_" + c))
        changed = d if changed is None else changed | d
    return j.withColumn("rebuild", F.coalesce(changed, F.lit(False))).drop(*["_prev_" + c for c in list(cols) + [seq]])
