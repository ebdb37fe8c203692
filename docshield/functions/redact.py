"""Redaction Column builders (R1, R2, R4 helpers, R6, R7, R8 counts).

Patterns are our own design (the reference's redactor module is absent from its tree).
They avoid look-around and ``\\b`` so that Java and RE2 (the oracle) match the same spans.
Digit-bordered rules consume one border character on each side; they are applied twice so
that two values separated by a single character are both caught.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PiiType:
    name: str          # entity type, also the token stem: [EMAIL_1]
    regex: str         # Java/RE2 compatible
    group: int         # capture group holding the value
    keep: tuple        # groups re-emitted around the placeholder (left, right) or ()
    passes: int        # how many times the replacement is applied

    @property
    def placeholder(self) -> str:
        return f"[{self.name}_REDACTED]"


# Fixed redaction order: credential -> e-mail -> card -> SSN -> phone, so that long digit
# runs are not eaten by the phone rule.
PII_TYPES = [
    PiiType("CREDENTIAL",
            r"(sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|AKIA[A-Z0-9]{16}"
            r"|(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Pp]assword)"
            r"\s*[=:]\s*\"[A-Za-z0-9_\-]{16,}\")",
            1, (), 1),
    PiiType("EMAIL", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", 1, (), 1),
    PiiType("CREDIT_CARD", r"(^|[^0-9])([0-9]{4}(?:[ -]?[0-9]{4}){3})([^0-9]|$)", 2, (1, 3), 2),
    PiiType("SSN", r"(^|[^0-9])([0-9]{3}-[0-9]{2}-[0-9]{4})([^0-9]|$)", 2, (1, 3), 2),
    PiiType("PHONE",
            r"(^|[^0-9+])((?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4})([^0-9]|$)",
            2, (1, 3), 2),
]
TYPE_ORDER = {t.name: i for i, t in enumerate(PII_TYPES)}

# Titled names (R2).  Value group 2 is the name without its title.
TITLE_NAME = r"(Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+(\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)?)"
NAME_PLACEHOLDER = "[NAME_REDACTED]"
MANUAL_PLACEHOLDER = "[MANUAL_REDACTED]"
WORD_L = r"(^|[^\p{L}\p{N}_])"
WORD_R = r"($|[^\p{L}\p{N}_])"
TOKEN_RE = r"\[(?:CREDENTIAL|EMAIL|CREDIT_CARD|SSN|PHONE|NAME|LITERAL)_[0-9]+\]"


def _java_repl(t: PiiType, repl: str) -> str:
    if not t.keep:
        return repl
    left, right = t.keep
    return f"${left}{repl}${right}"


# Necessary conditions of each type, one linear scan each.  Backtracking regex engines
# spend most of their time failing on texts without any candidate; the guard skips those
# texts, and results are unchanged because no match is possible without the condition.
GUARDS = {
    "CREDENTIAL": lambda c: (F.instr(c, "sk-") > 0) | (F.instr(c, "AKIA") > 0) | c.rlike("gh[pousr]_")
    | ((F.instr(c, "\"") > 0) & ((F.instr(c, "=") > 0) | (F.instr(c, ":") > 0))),
    "EMAIL": lambda c: F.instr(c, "@") > 0,
    "CREDIT_CARD": lambda c: c.rlike("[0-9]{4}"),
    "SSN": lambda c: c.rlike("[0-9]{3}-[0-9]{2}-"),
    "PHONE": lambda c: c.rlike("[0-9]{3}"),
}


def redact_type(c: Column, t: PiiType, repl: str | None = None) -> Column:
    out = c
    for _ in range(t.passes):
        out = F.regexp_replace(out, t.regex, _java_repl(t, repl or t.placeholder))
    guard = GUARDS.get(t.name)
    return out if guard is None else F.when(guard(c), out).otherwise(c)


def redact_names(c: Column) -> Column:
    """R2: titled names -> placeholder, then bare later uses of their name words."""
    names = F.regexp_extract_all(c, F.lit(TITLE_NAME), 2)
    words = F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(n, r"\s+"))))
    after_titles = F.regexp_replace(c, TITLE_NAME, NAME_PLACEHOLDER)

    def drop_word(acc, w):
        rx = F.concat(F.lit(WORD_L), w, F.lit(WORD_R))
        once = F.regexp_replace(acc, rx, F.lit("$1" + NAME_PLACEHOLDER + "$2"))
        return F.regexp_replace(once, rx, F.lit("$1" + NAME_PLACEHOLDER + "$2"))

    return F.aggregate(words, after_titles, drop_word)


def redact(c: Column, names: bool = False) -> Column:
    """R1 (+R2 when ``names``): typed placeholders in fixed order."""
    out = c
    for t in PII_TYPES:
        out = redact_type(out, t)
    if names:
        out = redact_names(out)
    return out


# Spans (R3, R5, R8): the types in order, with borders that take no character, so that values next
# to each other are all found.  A literal token in a text is a span of its own and gets a token like
# any value, so it can never be mistaken for another document's token.  A name keeps its title.
LITERAL = "LITERAL"
NAME = "NAME"
SPANS = {
    LITERAL: TOKEN_RE,
    "CREDENTIAL": PII_TYPES[0].regex,
    "EMAIL": PII_TYPES[1].regex,
    "CREDIT_CARD": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "SSN": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "PHONE": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    NAME: TITLE_NAME,
}
SPAN_ORDER = list(SPANS)
PLAIN = -1  # the type of a piece of text that is no entity


def may_have_spans(c: Column, names: bool = True) -> Column:
    """A necessary condition: texts that fail it hold no span."""
    out = F.instr(c, "[") > 0
    for t in PII_TYPES:
        out = out | GUARDS[t.name](c)
    return out | c.rlike("(?:Mr|Mrs|Ms|Miss|Dr|Prof)[. ]") if names else out


def _cutter(i: int, regex: str):
    """Cuts a plain piece into its plain parts and the spans of one type."""
    def cut(x: Column) -> Column:
        gaps, hits = F.split(x["s"], regex, -1), F.regexp_extract_all(x["s"], F.lit(regex), F.lit(0))
        both = F.flatten(F.zip_with(gaps, hits, lambda g, h: F.array(
            F.struct(F.lit(PLAIN).alias("t"), g.alias("s")), F.struct(F.lit(i).alias("t"), h.alias("s")))))
        both = F.filter(both, lambda y: y["s"].isNotNull() & (y["s"] != ""))
        return F.when(x["t"] == PLAIN, both).otherwise(F.array(x))

    return cut


def segments(c: Column, names: bool = True) -> Column:
    """The text as array<struct<t: type index or PLAIN, s: string>>, in order and complete: each type
    in turn cuts the pieces that are still plain, so spans never overlap and none is found inside
    another."""
    plain = F.array(F.struct(F.lit(PLAIN).alias("t"), c.alias("s")))
    out = plain
    for i, (name, regex) in enumerate(SPANS.items()):
        if name != NAME or names:
            out = F.flatten(F.transform(out, _cutter(i, regex)))
    return F.when(may_have_spans(c, names), out).otherwise(plain)


def span_type(t: Column) -> Column:
    """The name of a span's type."""
    return F.get(F.array(*[F.lit(n) for n in SPAN_ORDER]), t)


def manual_word_regex(word: str) -> str:
    """Java regex for one manual word: whole word, case-insensitive, literal (quoted)."""
    return r"(?iU)\b" + "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E" + r"\b"


def redact_words(c: Column, words: list[str]) -> Column:
    """Each non-empty word, in list order -> [MANUAL_REDACTED]."""
    out = c
    for w in words:
        if not w:
            continue
        out = F.regexp_replace(out, manual_word_regex(w), MANUAL_PLACEHOLDER)
    return out


def parse_words(c: Column) -> Column:
    """Split on ',', strip white space of all kinds, drop empties."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
