"""Guardrail Column builders.

Every check is one Column expression built from literal patterns, so Catalyst can fold
constants and the whole check stays inside whole-stage codegen.  Per-row custom rules
(an array column) use a higher-order ``filter``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# ---------------------------------------------------------------------------
JAILBREAK_PHRASES = [
    "ignore previous", "forget your instructions", "ignore all prior",
    "jailbreak", "dan mode", "pretend you are", "act as if you are",
    "you are now", "disregard your", "override your",
]

TIER_ORDER = ["Public", "Internal", "Confidential", "Restricted"]

TIER_DESCRIPTIONS = {
    "Public": "No data classification restrictions. Basic jailbreak protection only.",
    "Internal": "Suitable for internal business data. Blocks credential and API key exposure.",
    "Confidential": "For confidential data. Adds PII protection.",
    "Restricted": "Maximum protection. For highly sensitive or regulated data (HIPAA, GDPR, financial).",
}

TIER_BADGES = {"Public": "public", "Internal": "internal",
               "Confidential": "confidential", "Restricted": "restricted"}

TIER_INPUT_PATTERNS = {
    "Public": [],
    "Internal": ["api key", "api_key", "password", "secret key", "access token",
                 "private key", "credential"],
    "Confidential": ["api key", "api_key", "password", "secret key", "access token",
                     "private key", "credential", "social security", "ssn",
                     "date of birth", "home address", "phone number", "email address",
                     "credit card", "bank account"],
    "Restricted": ["api key", "api_key", "password", "secret key", "access token",
                   "private key", "credential", "social security", "ssn",
                   "date of birth", "home address", "phone number", "email address",
                   "credit card", "bank account", "medical record", "diagnosis",
                   "prescription", "patient", "salary", "tax return",
                   "financial statement", "trading", "investment"],
}

TIER_OUTPUT_PATTERNS = {
    "Public": [],
    "Internal": ["api_key", "api key", "password", "access_token", "credential",
                 "private_key", "bearer token"],
    "Confidential": ["api_key", "api key", "password", "access_token", "credential",
                     "private_key", "bearer token", "ssn", "social security",
                     "date of birth", "credit card", "bank account"],
    "Restricted": ["api_key", "api key", "password", "access_token", "credential",
                   "private_key", "bearer token", "ssn", "social security",
                   "date of birth", "credit card", "bank account", "medical record",
                   "diagnosis", "prescription", "patient id", "salary", "tax", "financial"],
}

MSG_JAILBREAK = ("This request has been blocked. Prompt injection and instruction-override "
                 "attempts are not permitted.")
MSG_INPUT_CUSTOM = "This request has been blocked under the custom safety policy rules: '{rule}'."
MSG_INPUT_TIER = "This request has been blocked under the active **{tier}** data sensitivity policy."
MSG_OUTPUT_CUSTOM = "[REDACTED — Output blocked by custom safety policy rules: '{rule}']"
MSG_OUTPUT_TIER = "[REDACTED — Output blocked by {tier} data sensitivity policy.]"

FALLBACK_TIER = "Internal"
# ---------------------------------------------------------------------------

_WORD_ONLY = re.compile(r"[a-z]+")


@dataclass
class Policy:
    """Tier -> ordered input/output patterns, description and badge (a small config table)."""

    inputs: dict[str, list[str]] = field(default_factory=dict)
    outputs: dict[str, list[str]] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    badges: dict[str, str] = field(default_factory=dict)

    @classmethod
    def default(cls) -> "Policy":
        return cls({k: list(v) for k, v in TIER_INPUT_PATTERNS.items()},
                   {k: list(v) for k, v in TIER_OUTPUT_PATTERNS.items()},
                   dict(TIER_DESCRIPTIONS), dict(TIER_BADGES))

    def tiers(self) -> list[str]:
        seen = list(self.descriptions) + list(self.inputs) + list(self.outputs)
        return list(dict.fromkeys(seen))

    def patterns(self, tier: str, direction: str) -> list[str]:
        table = self.inputs if direction == "in" else self.outputs
        if tier in table:
            return table[tier]
        # A saved policy without the fallback tier still checks with the built-in one.
        builtin = TIER_INPUT_PATTERNS if direction == "in" else TIER_OUTPUT_PATTERNS
        return table.get(FALLBACK_TIER, builtin[FALLBACK_TIER])


def _clean(pattern: str) -> str:
    return pattern.strip().lower()


def pattern_regex(pattern: str) -> str | None:
    """Java regex for a single-word pattern (whole word, optional plural), else None."""
    p = _clean(pattern)
    if p and _WORD_ONLY.fullmatch(p):
        return r"(?U)\b" + p + r"s?\b"
    return None


def matches(text: Column, pattern: str) -> Column:
    """G1 for a literal pattern: word match for a-z words, else substring, on lower case."""
    p = _clean(pattern)
    if not p:
        return F.lit(False)
    low = F.lower(text)
    rx = pattern_regex(p)
    if rx is not None:
        return low.rlike(rx)
    return F.instr(low, p) > 0


def matches_col(text: Column, pattern: Column) -> Column:
    """G1 for a pattern held in a column (per-row custom rules)."""
    p = F.lower(F.regexp_replace(pattern, r"(?U)^\s+|\s+$", ""))
    low = F.lower(text)
    word = F.regexp_like(p, F.lit("^[a-z]+$"))
    return (F.when(p.isNull() | (p == ""), F.lit(False))
            .when(word, F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), p, F.lit(r"s?\b"))))
            .otherwise(F.instr(low, p) > 0))


#: Policies of more patterns than this are matched by an automaton instead of one expression.
EXPRESSION_PATTERNS = 2000


def n_patterns(policy: "Policy") -> int:
    return sum(map(len, [*policy.inputs.values(), *policy.outputs.values()]))


#: Joiners, and the letters that Unicode counts among the symbols: word characters of Java's ``(?U)\\w``.
_JOINERS = "\u200c\u200d"
_LETTER_SYMBOLS = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))


def is_word_char(ch: str) -> bool:
    """Whether Java's ``(?U)\\w``, on whose borders a word pattern ends, takes the character."""
    import unicodedata
    kind = unicodedata.category(ch)
    return (kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or ch in _JOINERS
            or kind == "So" and any(a <= ord(ch) <= b for a, b in _LETTER_SYMBOLS))


def tier_hit_udf(policy: "Policy", direction: str):
    """First tier pattern hit for a policy too long for an expression: one Aho-Corasick automaton
    per tier finds all occurrences in one pass over the lower-cased text; the first pattern in list
    order whose word or substring rule holds is the hit, given as it was stored.  Same results as
    ``tier_hit``."""
    lists = {t: list(policy.patterns(t, direction)) for t in [*policy.tiers(), FALLBACK_TIER]}
    built: dict = {}

    def automaton(tier: str):
        import ahocorasick
        if tier not in built:
            a = ahocorasick.Automaton()
            for i, stored in reversed(list(enumerate(lists[tier]))):
                p = _clean(stored)
                if p:  # of patterns that clean to the same, the first in the list stays
                    a.add_word(p, (i, len(p), stored, bool(_WORD_ONLY.fullmatch(p))))
            if len(a):
                a.make_automaton()
            built[tier] = a
        return built[tier]

    def bounded(text: str, start: int, end: int) -> bool:
        def inside(k: int) -> bool:
            return 0 <= k < len(text) and is_word_char(text[k])
        return not inside(start - 1) and (not inside(end) or text[end] == "s" and not inside(end + 1))

    def hit(text, tier):
        a = automaton(tier if tier in lists else FALLBACK_TIER)
        if text is None or not len(a):
            return None
        best = None
        for end, (i, n, stored, word) in a.iter(text):
            if (best is None or i < best[0]) and (not word or bounded(text, end + 1 - n, end + 1)):
                best = (i, stored)
        return best and best[1]

    @F.pandas_udf("string")
    def first(low: pd.Series, tier: pd.Series) -> pd.Series:
        return pd.Series([hit(x, t) for x, t in zip(low, tier)], dtype=object)

    return first


def first_hit(text: Column, patterns: list[str]) -> Column:
    """First pattern (list order) that matches, else null.  CASE is ordered and lazy."""
    expr = None
    for p in patterns:
        cond = matches(text, p)
        expr = F.when(cond, F.lit(p)) if expr is None else expr.when(cond, F.lit(p))
    return F.lit(None).cast("string") if expr is None else expr


def jailbreak_hit(text: Column) -> Column:
    """First jailbreak phrase contained in the lower-cased text."""
    low = F.lower(text)
    expr = None
    for p in JAILBREAK_PHRASES:
        cond = F.instr(low, p) > 0
        expr = F.when(cond, F.lit(p)) if expr is None else expr.when(cond, F.lit(p))
    return expr


def is_jailbreak(text: Column) -> Column:
    return jailbreak_hit(text).isNotNull()


def custom_hit(text: Column, rules: Column) -> Column:
    """First custom rule (array order) that matches, else null."""
    return F.get(F.filter(rules, lambda r: matches_col(text, r)), 0)


def tier_hit(text: Column, tier: Column, policy: Policy, direction: str) -> Column:
    """First tier pattern hit; unknown tiers use the fallback tier's patterns."""
    known = [t for t in policy.tiers() if (policy.inputs if direction == "in" else policy.outputs).get(t) is not None]
    expr = None
    for t in known:
        cond = tier == F.lit(t)
        hit = first_hit(text, policy.patterns(t, direction))
        expr = F.when(cond, hit) if expr is None else expr.when(cond, hit)
    fallback = first_hit(text, policy.patterns(FALLBACK_TIER, direction))
    return fallback if expr is None else expr.otherwise(fallback)


def _fmt(template: str, **cols: Column) -> Column:
    """Render a message template with Column values (format_string on a %s template)."""
    tmpl = template
    order = []
    for m in re.finditer(r"\{(\w+)\}", template):
        order.append(m.group(1))
    tmpl = re.sub(r"\{(\w+)\}", "%s", template.replace("%", "%%"))
    return F.format_string(tmpl, *[cols[n] for n in order])


@dataclass
class GuardResult:
    message: Column
    kind: Column
    rule: Column


def combine(jb: Column, cu: Column, ti: Column, tier: Column, enabled: Column,
            direction: str) -> GuardResult:
    """Message / kind / rule from the three hits, in reference order: disabled -> pass;
    jailbreak (input only); custom rules; tier patterns."""
    on = F.coalesce(enabled, F.lit(True))
    kind = (F.when(~on, F.lit(None))
            .when(jb.isNotNull(), F.lit("jailbreak"))
            .when(cu.isNotNull(), F.lit("custom"))
            .when(ti.isNotNull(), F.lit("tier")))
    rule = (F.when(~on, F.lit(None))
            .when(jb.isNotNull(), jb)
            .when(cu.isNotNull(), cu)
            .when(ti.isNotNull(), ti))
    tier_s = F.coalesce(tier, F.lit("None"))
    if direction == "in":
        msg_custom = _fmt(MSG_INPUT_CUSTOM, rule=cu)
        msg_tier = _fmt(MSG_INPUT_TIER, tier=tier_s)
    else:
        msg_custom = _fmt(MSG_OUTPUT_CUSTOM, rule=cu)
        msg_tier = _fmt(MSG_OUTPUT_TIER, tier=tier_s)
    message = (F.when(~on, F.lit(None).cast("string"))
               .when(jb.isNotNull(), F.lit(MSG_JAILBREAK))
               .when(cu.isNotNull(), msg_custom)
               .when(ti.isNotNull(), msg_tier))
    return GuardResult(message, kind, rule)


def check(text: Column, tier: Column, enabled: Column, rules: Column | None,
          policy: Policy, direction: str) -> GuardResult:
    """G3 (direction 'in') / G4 (direction 'out') as Columns: first hit wins, in reference
    order.  Returns the message (null = pass), the kind of rule and the rule itself.
    (``operators.guarding.guard_columns`` is the staged operator form.)"""
    jb = jailbreak_hit(text) if direction == "in" else F.lit(None).cast("string")
    cu = custom_hit(text, rules) if rules is not None else F.lit(None).cast("string")
    ti = tier_hit(text, tier, policy, direction)
    return combine(jb, cu, ti, tier, enabled, direction)


def check_input(text, tier, enabled, rules, policy: Policy | None = None) -> GuardResult:
    return check(text, tier, enabled, rules, policy or Policy.default(), "in")


def check_output(text, tier, enabled, rules, policy: Policy | None = None) -> GuardResult:
    return check(text, tier, enabled, rules, policy or Policy.default(), "out")


def violations_array(text: Column, tier: Column, policy: Policy, direction: str,
                     with_jailbreak: bool = True) -> Column:
    """Every matching rule of the row's effective tier, as array<struct<kind,ord,pattern>>.

    One literal ``when`` per (tier, pattern), filtered for nulls: no join, no Python.
    """
    items = []
    if direction == "in" and with_jailbreak:
        for i, p in enumerate(JAILBREAK_PHRASES):
            items.append(F.when(F.instr(F.lower(text), p) > 0,
                                F.struct(F.lit("jailbreak").alias("kind"), F.lit(i).alias("ord"),
                                         F.lit(p).alias("pattern"))))
    known = [t for t in policy.tiers() if (policy.inputs if direction == "in" else policy.outputs).get(t) is not None]
    is_known = tier.isin(known) if known else F.lit(False)
    eff = F.when(is_known, tier).otherwise(F.lit(FALLBACK_TIER))
    tiers = set(known) | {FALLBACK_TIER}
    for t in sorted(tiers):
        for i, p in enumerate(policy.patterns(t, direction)):
            items.append(F.when((eff == F.lit(t)) & matches(text, p),
                                F.struct(F.lit("tier").alias("kind"), F.lit(i).alias("ord"),
                                         F.lit(p).alias("pattern"))))
    if not items:
        return F.array().cast("array<struct<kind:string,ord:int,pattern:string>>")
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def status_light(tier: Column, enabled: Column) -> Column:
    """(light, label) of the safety dashboard; unknown tier -> null."""
    off = ~F.coalesce(enabled, F.lit(True))
    light = (F.when(off | (tier == "Public"), F.lit("green"))
             .when(tier.isin("Internal", "Confidential"), F.lit("orange"))
             .when(tier == "Restricted", F.lit("red")))
    label = (F.when(light == "green", F.lit("SAFE"))
             .when(light == "orange", F.lit("PROTECTED"))
             .when(light == "red", F.lit("STRICT")))
    return F.struct(light.alias("light"), label.alias("label"))


# ---------------------------------------------------------------------------
# Spark SQL text forms of the same checks.  An operator that knows its column names builds
# each hit as one expression string (one parse on the JVM) instead of hundreds of Column
# objects, over a lower-cased column computed once.
def spark_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(low: str, pattern: str) -> str:
    p = _clean(pattern)
    if not p:
        return "false"
    rx = pattern_regex(p)
    if rx is not None:
        return f"({low} RLIKE {spark_str(rx)})"
    return f"(instr({low}, {spark_str(p)}) > 0)"


def first_hit_sql(low: str, patterns: list[str]) -> str:
    if not patterns:
        return "CAST(NULL AS STRING)"
    return "CASE " + " ".join(f"WHEN {matches_sql(low, p)} THEN {spark_str(p)}" for p in patterns) + " END"


def jailbreak_hit_sql(low: str) -> str:
    return "CASE " + " ".join(f"WHEN instr({low}, {spark_str(p)}) > 0 THEN {spark_str(p)}"
                              for p in JAILBREAK_PHRASES) + " END"


def tier_hit_sql(low: str, tier: str, policy: Policy, direction: str) -> str:
    table = policy.inputs if direction == "in" else policy.outputs
    known = [t for t in policy.tiers() if table.get(t) is not None]
    whens = " ".join(f"WHEN {tier} = {spark_str(t)} THEN {first_hit_sql(low, policy.patterns(t, direction))}"
                     for t in known)
    fallback = first_hit_sql(low, policy.patterns(FALLBACK_TIER, direction))
    return f"CASE {whens} ELSE {fallback} END" if whens else fallback


def violations_sql(low: str, tier: str, policy: Policy, direction: str, with_jailbreak: bool = True) -> str:
    """G7 as one SQL expression: array of struct(kind, ord, pattern) of every hit."""
    items = []
    if direction == "in" and with_jailbreak:
        for i, p in enumerate(JAILBREAK_PHRASES):
            items.append(f"CASE WHEN instr({low}, {spark_str(p)}) > 0 THEN "
                         f"named_struct('kind', 'jailbreak', 'ord', {i}, 'pattern', {spark_str(p)}) END")
    table = policy.inputs if direction == "in" else policy.outputs
    known = [t for t in policy.tiers() if table.get(t) is not None]
    known_sql = ", ".join(spark_str(t) for t in known) or "''"
    eff = f"(CASE WHEN {tier} IN ({known_sql}) THEN {tier} ELSE {spark_str(FALLBACK_TIER)} END)"
    for t in sorted(set(known) | {FALLBACK_TIER}):
        for i, p in enumerate(policy.patterns(t, direction)):
            items.append(f"CASE WHEN {eff} = {spark_str(t)} AND {matches_sql(low, p)} THEN "
                         f"named_struct('kind', 'tier', 'ord', {i}, 'pattern', {spark_str(p)}) END")
    if not items:
        return "CAST(array() AS array<struct<kind:string,ord:int,pattern:string>>)"
    return f"filter(array({', '.join(items)}), x -> x IS NOT NULL)"
