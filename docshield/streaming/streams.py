"""Structured Streaming forms.

- T1 ``stream_ingest``: new document files -> redact -> chunk -> embed -> append to the
  index, skipping documents that are indexed with the same content already (F2 anti join on a
  per-document key inside ``foreachBatch``), so documents delivered twice are indexed once.  Each
  micro-batch writes its own ``epoch`` partition with dynamic overwrite, so a retried batch
  replaces exactly what it wrote (idempotent sink).
- T2 ``stream_guard``: requests through the input guard; a stateless projection built
  from the same Column builders as the batch form.  ``stream_turns``: questions and the model's
  answers through both guards, with responses and audit events as two sinks of one micro-batch,
  each in its own ``epoch`` partition; an epoch counts once its marker stands, which is written
  last, so a reader sees all sinks of an epoch or none, and a replay replaces them.
  ``session_settings``: the sticky rules (G15) and setting changes (H9) of each session as keyed state.
- T3 ``stream_audit_rollup``: event counts per type in tumbling windows, in append mode: a window is
  written once, when the watermark passes its end, and its state is dropped; events later than
  that are ignored.
Outputs and checkpoints live under the cluster's checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield.functions import guard as G
from docshield.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet",
                max_files: int = 1) -> DataFrame:
    """File stream over ``folder`` (files matching ``glob``) with the schema of a batch frame
    (no inference on streams), at most ``max_files`` new files a micro-batch."""
    return (spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", glob).parquet(folder))


def stream_guard(requests: DataFrame, policy: G.Policy | None = None) -> DataFrame:
    """Adds ``blocked``, ``rule_kind``, ``rule``, ``message`` (input check) per request."""
    from docshield.operators import guarding
    r = guarding.check_input(requests, policy=policy, prefix="_g_")
    return r.select(*requests.columns, F.col("_g_message").isNotNull().alias("blocked"), F.col("_g_kind").alias("rule_kind"),
                    F.col("_g_rule").alias("rule"), F.col("_g_message").alias("message"))


def responses(rows: DataFrame, policy: G.Policy | None = None) -> DataFrame:
    """T2 over rows with ``question`` and the model's ``answer``: what the reader gets (``source``,
    ``blocked``, ``shown``, ``rule``).  Answers to blocked questions are not looked at."""
    from docshield.operators import guarding
    asked = guarding.check_input(rows, policy=policy, prefix="in_")
    asked = asked.withColumn("_given", F.when(F.col("in_message").isNull(), F.col("answer")))
    told = guarding.check_output(asked, "_given", policy=policy, prefix="out_")
    source = F.when(F.col("in_message").isNotNull(), "input_guard").when(F.col("out_message").isNotNull(), "output_guard")
    return told.select(*rows.columns, F.coalesce(source, F.lit("llm")).alias("source"), source.isNotNull().alias("blocked"),
                       F.coalesce("in_message", "out_message", "answer").alias("shown"),
                       F.coalesce("in_rule", "out_rule").alias("rule"))


def _write_epoch(df: DataFrame, folder: str, epoch: int) -> None:
    """One sink's rows of an epoch; what an earlier try wrote of it is replaced."""
    df.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(folder)


def stream_turns(stream: DataFrame, out: str, checkpoint: str, policy: G.Policy | None = None, write=_write_epoch):
    """T2 whole: starts the stream (``availableNow``) of questions and answers into ``out``/responses,
    ``out``/audit and ``out``/epochs (the markers); read them with ``read_epochs``."""
    from docshield.operators import audit

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = responses(batch, policy).persist()
        try:
            write(rows, f"{out}/responses", epoch)
            write(audit.turn_events(rows.withColumn("n_citations", F.lit(0))), f"{out}/audit", epoch)
            write(spark.range(1).select(F.current_timestamp().alias("done_at")), f"{out}/epochs", epoch)
        finally:
            rows.unpersist()

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_epochs(spark: SparkSession, out: str, sink: str) -> DataFrame | None:
    """The rows of a sink in the epochs that are whole; None before the first."""
    from docshield.sources.stores import read_if_there
    done, rows = read_if_there(spark, f"{out}/epochs"), read_if_there(spark, f"{out}/{sink}")
    if done is None or rows is None:
        return None
    return rows.join(done.select("epoch").distinct(), "epoch", "left_semi")


SETTINGS = ["model", "host", "system_prompt"]
SETTINGS_STATE = "turn bigint, rules array<string>, model string, host string, system_prompt string"
SETTINGS_OUT = "conv_id bigint, turn bigint, effective_rules array<string>, rebuild boolean"


def session_settings(requests: DataFrame, time: str | None = None, lateness: str = "10 minutes",
                     idle_ms: int = 3_600_000) -> DataFrame:
    """T2 state: per request the session's last non-empty rules (G15) and whether model, host or
    system prompt differ from the session's previous request (H9), across micro-batches.

    The state of a session is its last request's settings.  With a ``time`` column it is dropped when
    the watermark is ``idle_ms`` past the session's last request (a later request starts anew, and
    requests behind the watermark are left out); without one it lives as long as the checkpoint.
    Requests of a session are taken in order of ``turn``; one that is not after the last one taken
    was delivered before and is left out.  A task holds the settings (no texts) of one session's
    requests of one micro-batch, which the source's trigger bounds."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, rules, *old = state.get if state.exists else (None, [], None, None, None)
        rules, old = list(rules), list(old)
        made = []
        # lists of the columns: most sessions have a row or two, and a frame costs more than they do
        cols = {}
        for frame in frames:
            for c in frame.columns:
                cols.setdefault(c, []).extend(frame[c].tolist())
        rows = zip(*[cols[c] for c in ("turn", "custom_rules", *SETTINGS)])
        for turn, own, *now in sorted(rows, key=lambda r: r[0]):
            if last is not None and turn <= last:
                continue
            now = [None if x is None or x != x else x for x in now]
            rules = list(own) if own is not None and len(own) else rules
            made.append((key[0], turn, rules, last is not None and now != old))
            last, old = int(turn), now
        state.update((last, rules, *old))
        if time is not None:
            newest = int(max(cols["at_ms"]))
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=["conv_id", "turn", "effective_rules", "rebuild"])

    narrow = requests.select("conv_id", "turn", "custom_rules", *SETTINGS)
    timeout = GroupStateTimeout.NoTimeout
    if time is not None:
        at = F.col(time).cast("timestamp")
        narrow = requests.select("conv_id", "turn", "custom_rules", *SETTINGS, at.alias("at"), F.unix_millis(at).alias("at_ms")) \
            .withWatermark("at", lateness)
        timeout = GroupStateTimeout.EventTimeTimeout
    return narrow.groupBy("conv_id").applyInPandasWithState(run, SETTINGS_OUT, SETTINGS_STATE, "append", timeout)


def deliver(parts: list[DataFrame], folder: str, start) -> None:
    """Writes each part, with its own partitioning, into a folder of its own and lets the stream that
    ``start`` makes of ``folder`` take it as one micro-batch (stand-in for files that arrive)."""
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/part-{k}")
        start().awaitTermination()


def stream_audit_rollup(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes",
                        ts: str = "ts") -> DataFrame:
    """Tumbling-window counts per event type with a watermark."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return (e.groupBy(F.window("_ts", window).alias("w"), "event_type")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
             .select(F.col("w.start").alias("window_start"), "event_type", "n", "total_value"))


def start_to_parquet(df: DataFrame, out: str):
    """Start a stream in append mode over all available input (``availableNow``)."""
    return (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_ckpt")
              .outputMode("append").trigger(availableNow=True).start())


def run_to_parquet(df: DataFrame, out: str) -> None:
    """Drive a stream in append mode over all available input, then stop."""
    start_to_parquet(df, out).awaitTermination()


def document_key():
    """F2 for one document: a digest of what is indexed of it."""
    sep = F.lit("\x1f")
    return F.md5(F.concat(F.col("doc_id").cast("string"), sep, F.coalesce("source", F.lit("")), sep,
                          F.coalesce("text", F.lit(""))))


def stream_ingest(spark: SparkSession, docs_stream: DataFrame, index_path: str, checkpoint: str,
                  size: int = 1000, overlap: int = 200):
    """Incremental index build; returns the started query (availableNow trigger)."""
    from docshield.plans.turns import build_index
    from docshield.session import cut_lineage
    from docshield.sources.stores import read_if_there, write_index

    def ingest(batch: DataFrame, epoch: int) -> None:
        docs = batch.select("collection", "doc_id", "source", "text").withColumn("doc_key", document_key())
        docs = docs.dropDuplicates(["collection", "doc_key"])
        index = read_if_there(spark, index_path)
        if index is not None:
            # what this very batch wrote before it was retried counts as not there
            known = index.where(F.col("epoch") != epoch).select("collection", "doc_key").distinct()
            docs = docs.join(known, ["collection", "doc_key"], "left_anti")
        # written once: the store's range partitioning samples its input before it writes it
        made = cut_lineage(build_index(docs, size, overlap).withColumn("epoch", F.lit(epoch)))
        write_index(made, index_path, partition=["collection", "epoch"])

    return (docs_stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
