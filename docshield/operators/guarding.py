"""Guard operators over DataFrames (G3, G4, G7, G9, G13, G14, G15; G8 lives in sources)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield.functions import guard as G
from docshield.operators import policy_index as P


def tier_rule(low: str, tier: str, policy: G.Policy, direction: str):
    """The first tier pattern that a lower-cased text holds, as it was stored, for a policy of any
    size: an expression, or an automaton where that would grow too large; both give the same."""
    if G.n_patterns(policy) > G.EXPRESSION_PATTERNS:
        return G.tier_hit_udf(policy, direction)(F.col(low), F.col(tier))
    return F.expr(G.tier_hit_sql(f"`{low}`", f"`{tier}`", policy, direction))


def guard_columns(df: DataFrame, text: str, tier: str, enabled: str, rules: str | None,
                  policy: G.Policy | P.PolicyTables | None, direction: str, prefix: str) -> DataFrame:
    """G3/G4 as an operator, by a policy in memory or by one that stays a table.  The three hits (jailbreak, custom, tier) are computed once in
    their own projection; message, kind and rule then read them.  Each hit is referenced
    several times, so Catalyst keeps the projections apart instead of inlining the
    regex-heavy expressions three times."""
    policy = policy or G.Policy.default()
    low = "`_low`"
    jb = F.expr(G.jailbreak_hit_sql(low)) if direction == "in" else F.lit(None).cast("string")
    cu = G.custom_hit(F.col(text), F.col(rules)) if rules else F.lit(None).cast("string")
    if isinstance(policy, P.PolicyTables):
        ti, rows = F.col("_first"), P.with_rule(df, text, tier, policy, direction, "_first")
    else:
        ti, rows = tier_rule("_low", tier, policy, direction), df
    lowered = rows.select("*", F.lower(F.col(text)).alias("_low"))
    staged = lowered.select(*df.columns, jb.alias("_jb"), cu.alias("_cu"), ti.alias("_ti"))
    r = G.combine(F.col("_jb"), F.col("_cu"), F.col("_ti"), F.col(tier), F.col(enabled), direction)
    return staged.select(*df.columns, r.message.alias(prefix + "message"), r.kind.alias(prefix + "kind"),
                         r.rule.alias(prefix + "rule"))


def tier_hits(df: DataFrame, text: str, tier: str, policy: G.Policy | P.PolicyTables, direction: str, out: str = "rule") -> DataFrame:
    """G1 over a table: adds ``out``, the first tier pattern that the text holds."""
    if isinstance(policy, P.PolicyTables):
        return P.with_rule(df, text, tier, policy, direction, out)
    low = df.select("*", F.lower(F.col(text)).alias("_low"))
    return low.select(*df.columns, tier_rule("_low", tier, policy, direction).alias(out))


def check_input(df: DataFrame, text: str = "question", tier: str = "tier",
                enabled: str = "enabled", rules: str | None = "custom_rules",
                policy: G.Policy | None = None, prefix: str = "in_") -> DataFrame:
    """Adds ``{prefix}message``, ``{prefix}kind``, ``{prefix}rule``; null message = pass."""
    return guard_columns(df, text, tier, enabled, rules, policy, "in", prefix)


def check_output(df: DataFrame, text: str = "answer", tier: str = "tier",
                 enabled: str = "enabled", rules: str | None = "custom_rules",
                 policy: G.Policy | None = None, prefix: str = "out_") -> DataFrame:
    """Output check (no jailbreak test, output patterns, ``[REDACTED ...]`` messages)."""
    return guard_columns(df, text, tier, enabled, rules, policy, "out", prefix)


def violations(df: DataFrame, text: str, tier: str, direction: str = "in",
               policy: G.Policy | None = None, keep: list[str] | None = None,
               enabled: str | None = None, rules: str | None = None) -> DataFrame:
    """Long form, one row per (input row, matching rule). Row-local; no join.  With ``rules`` the
    row's custom rules count too (``ord``: their place), with ``enabled`` switched-off rows have none."""
    policy = policy or G.Policy.default()
    arr = F.expr(G.violations_sql("`_low`", f"`{tier}`", policy, direction))
    if rules:
        custom = F.transform(F.coalesce(F.col(rules), F.array().cast("array<string>")), lambda r, i: F.when(
            G.matches_col(F.col("_low"), r), F.struct(F.lit("custom").alias("kind"), i.alias("ord"), r.alias("pattern"))))
        arr = F.concat(arr, F.filter(custom, lambda x: x.isNotNull()))
    if enabled:
        arr = F.when(F.coalesce(F.col(enabled), F.lit(True)), arr)
    keep = keep if keep is not None else [c for c in df.columns]
    used = [c for c in (tier, enabled, rules) if c]
    lowered = df.select(*dict.fromkeys(keep + used), F.lower(F.col(text)).alias("_low"))
    return (lowered.select(*keep, F.explode(arr).alias("v"))
              .select(*keep, F.col("v.kind").alias("kind"), F.col("v.ord").alias("ord"),
                      F.col("v.pattern").alias("pattern")))


def pattern_hit_counts(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """G1 over a table: number of rows each pattern matches, in one scan (partial aggs)."""
    aggs = [F.count_if(G.matches(F.col(text), p)).alias(f"c{i}") for i, p in enumerate(patterns)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"{i}, '{p.replace(chr(39), chr(39) * 2)}', c{i}" for i, p in enumerate(patterns))
    return wide.selectExpr(f"stack({len(patterns)}, {stack}) AS (ord, pattern, n_rows)")


def sticky_rules(df: DataFrame, session: str = "conv_id", seq: str = "turn",
                 rules: str = "custom_rules", out: str = "effective_rules") -> DataFrame:
    """A session keeps its last non-empty rule list (request order).  A running ``last``
    by a two-level scan, so one very long session is not one task."""
    from docshield.operators.ordinal import running_last
    nonempty = F.when(F.size(F.col(rules)) > 0, F.col(rules))
    out_df = running_last(df, [session], [seq], nonempty, out)
    return out_df.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def upsert_tier(policy_rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace every row of the edited tiers, keep the others (anti join + union); for the
    patterns (``policy_rows``) and for description and badge (``tiers_frame``) alike."""
    kept = policy_rows.join(edits.select("tier").distinct(), "tier", "left_anti")
    return kept.unionByName(edits.select(*policy_rows.columns))


def match_profile(settings: DataFrame, profiles: DataFrame, keys=("chunk_size", "chunk_overlap",
                                                                   "sensitivity", "guardrails"),
                  id_cols=None) -> DataFrame:
    """First profile (by ``ord``) equal on the four settings, else null.

    ``profiles`` is a config table; its size is checked before it is broadcast.
    """
    from docshield.operators.sizing import broadcast_if_small
    p = profiles.select(*keys, F.struct("ord", "name").alias("_p"))
    best = p.groupBy(*keys).agg(F.min("_p").alias("_p"))
    joined = settings.join(broadcast_if_small(best, 100_000), list(keys), "left")
    return joined.withColumn("profile", F.col("_p.name")).drop("_p")


def merge_profiles(base: DataFrame, custom: DataFrame, key: str = "key") -> DataFrame:
    """Custom profiles override built-ins by key (anti join + union); order kept."""
    kept = base.join(custom.select(key), key, "left_anti")
    return kept.unionByName(custom.select(*base.columns))


# The built-in UI profiles (key, display name, chunk size, overlap, tier,
# guardrails, custom rules), in their display order.
UI_PROFILES = [
    ("balanced", "Balanced (Default)", 1000, 200, "Internal", True, ""),
    ("strict", "Strict Privacy", 1000, 200, "Restricted", True,
     "ssn, password, api key, credit card, medical record"),
    ("fast", "Fast Summarizer", 600, 100, "Public", True, ""),
]
PROFILE_SCHEMA = ("key string, name string, ord int, chunk_size int, chunk_overlap int, "
                  "sensitivity string, guardrails boolean, rules string")


def ui_profiles(spark):
    rows = [(k, n, i, cs, co, s, g, r) for i, (k, n, cs, co, s, g, r) in enumerate(UI_PROFILES)]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def policy_rows(spark, policy: G.Policy | None = None):
    """The policy as a table (tier, direction, ord, pattern) -- the form that is stored."""
    policy = policy or G.Policy.default()
    rows = []
    for t in policy.tiers():
        for d, table in (("in", policy.inputs), ("out", policy.outputs)):
            for i, p in enumerate(table.get(t, [])):
                rows.append((t, d, i, p))
    return spark.createDataFrame(rows, "tier string, direction string, ord int, pattern string")


def tiers_frame(spark, policy: G.Policy | None = None):
    """Tier -> description, badge."""
    policy = policy or G.Policy.default()
    rows = [(t, policy.descriptions.get(t), policy.badges.get(t)) for t in policy.tiers()]
    return spark.createDataFrame(rows, "tier string, description string, badge string")


def policy_from_rows(rows_df, tiers_df=None) -> G.Policy:
    """Build the policy from a stored policy table.  Every row counts, however many there are: a
    policy is configuration, which each task holds to check a text (see ``guard_columns``)."""
    rows = rows_df.select("tier", "direction", "ord", "pattern").collect()
    p = G.Policy({}, {}, {}, {})
    for r in sorted(rows, key=lambda r: (r["tier"], r["direction"], r["ord"])):
        (p.inputs if r["direction"] == "in" else p.outputs).setdefault(r["tier"], []).append(r["pattern"])
    for t in list(p.inputs) + list(p.outputs):
        p.inputs.setdefault(t, [])
        p.outputs.setdefault(t, [])
    if tiers_df is not None:
        for r in tiers_df.select("tier", "description", "badge").collect():
            p.descriptions[r["tier"]] = r["description"]
            p.badges[r["tier"]] = r["badge"]
            # a tier without patterns (e.g. Public) has no pattern rows but must still exist,
            # or its requests would fall back to the Internal patterns
            p.inputs.setdefault(r["tier"], [])
            p.outputs.setdefault(r["tier"], [])
    return p
