"""Audit log (A1-A4): events are rows ``(ts, event_type, message, details)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Audit cap and event messages.
AUDIT_CAP = 200
MSG_INPUT_BLOCKED = "Input question blocked by %s policy."
MSG_OUTPUT_BLOCKED = "LLM output blocked and redacted under %s policy."
MSG_REDACTION = "Redacted user query before LLM processing."
MSG_RETRIEVAL = "Successfully completed RAG query in %.3fs"
MSG_UPLOAD = "Indexed %d file(s) into database %s"


def turn_events(responses: DataFrame, redacted: bool = False) -> DataFrame:
    """A1: one event per response (safety_alert for blocked, retrieval for answered), plus a
    redaction event per answered question when the collection is redacted."""
    tier = F.coalesce(F.col("tier"), F.lit("None"))
    blocked_in = F.col("source") == "input_guard"
    blocked_out = F.col("source") == "output_guard"
    lat = F.col("latency_sec") if "latency_sec" in responses.columns else F.lit(0.0)
    lat = F.coalesce(lat.cast("double"), F.lit(0.0))
    main = F.struct(
        F.when(blocked_in | blocked_out, F.lit("safety_alert")).otherwise(F.lit("retrieval")).alias("event_type"),
        F.when(blocked_in, F.format_string(MSG_INPUT_BLOCKED, tier))
         .when(blocked_out, F.format_string(MSG_OUTPUT_BLOCKED, tier))
         .otherwise(F.format_string(MSG_RETRIEVAL, lat)).alias("message"),
        F.when(blocked_in, F.create_map(F.lit("question"), F.col("question")))
         .when(blocked_out, F.create_map().cast("map<string,string>"))
         .otherwise(F.create_map(F.lit("latency_sec"), F.format_string("%.3f", lat),
                                 F.lit("citations_count"), F.col("n_citations").cast("string"),
                                 F.lit("question"), F.col("question"))).alias("details"))
    items = [main]
    if redacted:
        items.append(F.when(~blocked_in, F.struct(F.lit("redaction").alias("event_type"),
                                                  F.lit(MSG_REDACTION).alias("message"),
                                                  F.create_map().cast("map<string,string>").alias("details"))))
    keep = [c for c in ("conv_id", "turn", "ts") if c in responses.columns]
    ev = responses.select(*keep, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("e"))
    return ev.select(*keep, "e.event_type", "e.message", "e.details")


def upload_events(registered: DataFrame, n_files: str = "n_files", db_id: str = "db_id") -> DataFrame:
    """A1: one ``upload`` event per indexed collection, from its key, number of files, ``model``,
    ``chunk_size`` and ``redact_pii``."""
    details = F.create_map(*[x for c in ("model", "chunk_size", "redact_pii") for x in (F.lit(c), F.col(c).cast("string"))])
    return registered.select(
        F.col(db_id).alias("db_id"), F.lit("upload").alias("event_type"),
        F.format_string(MSG_UPLOAD, F.col(n_files).cast("int"), F.col(db_id)).alias("message"), details.alias("details"))


def retain(audit: DataFrame, n: int = AUDIT_CAP, ts: str = "ts", tiebreak: str = "event_id",
           per: str | None = None) -> DataFrame:
    """A2: newest ``n`` events (top-k, no full sort); per-group form with ``per``."""
    if per is None:
        return audit.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(n)
    w = Window.partitionBy(per).orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    return audit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def audit_view(audit: DataFrame, ts: str = "ts", event_type: str = "event_type") -> DataFrame:
    """A3: time as HH:MM:SS and type upper-cased (arrival order kept by ``ts``)."""
    return audit.withColumn("time", F.date_format(F.col(ts), "HH:mm:ss")) \
        .withColumn("type", F.upper(F.col(event_type)))


def exact_quantiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """(group, one column per point): exact quantiles with linear interpolation (nulls left out).

    No group's values are gathered: rows are range-partitioned by (group, value), which splits a hot
    group over many tasks, and get their rank from the partitions' counts; only the rows at the
    wanted ranks, two a point, are kept and combined."""
    from docshield.operators.ordinal import ordinal_in_groups
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("g", F.struct("g"))  # a null group is a group
    ranked = ordinal_in_groups(rows, ["g"], ["v"], out="at", force_split=True)
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in points.items()])
    wanted = (rows.groupBy("g").agg((F.count(F.lit(1)) - 1).alias("top")).select("g", "top", F.explode(names).alias("p"))
              .select("g", F.col("p.name").alias("name"), (F.col("top") * F.col("p.q")).alias("pos"))
              .select("g", "name", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("i")))
    # the value at a point: its two neighbours, each weighted by the nearness of the point
    met = ranked.join(wanted.withColumn("at", F.col("i") + 1), ["g", "at"])
    share = F.col("v") * (1 - F.abs(F.col("pos") - F.col("i")))
    return met.groupBy("g").agg(*[F.sum(F.when(F.col("name") == n, share)).alias(n) for n in points]) \
        .select(F.col("g.g").alias(group), *points)


def turn_metrics(audit: DataFrame, value: str = "value", event_type: str = "event_type",
                 slow: float = 10.0) -> DataFrame:
    """A4: per event type counts, mean, exact median and p95, and slow-event counts."""
    counts = audit.groupBy(event_type).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg(value), 6).alias("mean_value"),
        F.count_if(F.col(value) > slow).cast("bigint").alias("n_slow"))
    q = exact_quantiles(audit, event_type, value, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(event_type, "_type")
    both = counts.join(q, counts[event_type].eqNullSafe(q["_type"]), "left").drop("_type")
    return both.select(event_type, "n", "mean_value", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n_slow")
