"""DuckDB SQL fragments for the oracle twins of the Column builders.

DuckDB's regex engine is RE2: ASCII ``\\b``, no look-around.  Word tests therefore use
explicit borders ``(^|[^\\p{L}\\p{N}_])``, which match the same rows as Java's ``(?U)\\b``.
"""

from __future__ import annotations

import re

from docshield.functions import guard as G
from docshield.plans.bindings import sql_str

WB_L = r"(^|[^\p{L}\p{N}_])"
WB_R = r"($|[^\p{L}\p{N}_])"


def matches(text: str, pattern: str) -> str:
    p = pattern.strip().lower()
    if not p:
        return "FALSE"
    if re.fullmatch(r"[a-z]+", p):
        return f"regexp_matches(lower({text}), {sql_str(WB_L + p + 's?' + WB_R)})"
    return f"contains(lower({text}), {sql_str(p)})"


def matches_col(text: str, pat: str) -> str:
    p = f"lower(regexp_replace({pat}, '^[\\s\\v]+|[\\s\\v]+$', '', 'g'))"
    return (f"(CASE WHEN {p} IS NULL OR {p} = '' THEN FALSE "
            f"WHEN regexp_full_match({p}, '[a-z]+') THEN regexp_matches(lower({text}), "
            f"{sql_str(WB_L)} || {p} || {sql_str('s?' + WB_R)}) "
            f"ELSE contains(lower({text}), {p}) END)")


def first_hit(text: str, patterns: list[str]) -> str:
    if not patterns:
        return "CAST(NULL AS VARCHAR)"
    whens = " ".join(f"WHEN {matches(text, p)} THEN {sql_str(p)}" for p in patterns)
    return f"(CASE {whens} END)"


def jailbreak_hit(text: str) -> str:
    whens = " ".join(f"WHEN contains(lower({text}), {sql_str(p)}) THEN {sql_str(p)}"
                     for p in G.JAILBREAK_PHRASES)
    return f"(CASE {whens} END)"


def custom_hit(text: str, rules: str) -> str:
    return f"(list_filter({rules}, lambda r: {matches_col(text, 'r')}))[1]"


def tier_hit(text: str, tier: str, direction: str, policy: G.Policy | None = None) -> str:
    policy = policy or G.Policy.default()
    table = policy.inputs if direction == "in" else policy.outputs
    whens = " ".join(f"WHEN {tier} = {sql_str(t)} THEN {first_hit(text, policy.patterns(t, direction))}"
                     for t in policy.tiers() if t in table)
    fb = first_hit(text, policy.patterns(G.FALLBACK_TIER, direction))
    return f"(CASE {whens} ELSE {fb} END)"


def check(text: str, tier: str, enabled: str, rules: str | None, direction: str, ti: str | None = None) -> dict[str, str]:
    """SQL for message / kind / rule of G3 ('in') or G4 ('out'); ``ti``: the first tier pattern, if not of the default policy."""
    jb = jailbreak_hit(text) if direction == "in" else "CAST(NULL AS VARCHAR)"
    cu = custom_hit(text, rules) if rules else "CAST(NULL AS VARCHAR)"
    ti = ti or tier_hit(text, tier, direction)
    on = f"coalesce({enabled}, TRUE)"
    tier_s = f"coalesce({tier}, 'None')"
    if direction == "in":
        mc = (sql_str(G.MSG_INPUT_CUSTOM.split("{rule}")[0]) + f" || {cu} || "
              + sql_str(G.MSG_INPUT_CUSTOM.split("{rule}")[1]))
        mt = (sql_str(G.MSG_INPUT_TIER.split("{tier}")[0]) + f" || {tier_s} || "
              + sql_str(G.MSG_INPUT_TIER.split("{tier}")[1]))
    else:
        mc = (sql_str(G.MSG_OUTPUT_CUSTOM.split("{rule}")[0]) + f" || {cu} || "
              + sql_str(G.MSG_OUTPUT_CUSTOM.split("{rule}")[1]))
        mt = (sql_str(G.MSG_OUTPUT_TIER.split("{tier}")[0]) + f" || {tier_s} || "
              + sql_str(G.MSG_OUTPUT_TIER.split("{tier}")[1]))
    return {
        "message": (f"(CASE WHEN NOT {on} THEN NULL WHEN {jb} IS NOT NULL THEN {sql_str(G.MSG_JAILBREAK)} "
                    f"WHEN {cu} IS NOT NULL THEN {mc} WHEN {ti} IS NOT NULL THEN {mt} END)"),
        "kind": (f"(CASE WHEN NOT {on} THEN NULL WHEN {jb} IS NOT NULL THEN 'jailbreak' "
                 f"WHEN {cu} IS NOT NULL THEN 'custom' WHEN {ti} IS NOT NULL THEN 'tier' END)"),
        "rule": (f"(CASE WHEN NOT {on} THEN NULL WHEN {jb} IS NOT NULL THEN {jb} "
                 f"WHEN {cu} IS NOT NULL THEN {cu} WHEN {ti} IS NOT NULL THEN {ti} END)"),
    }


# --------------------------------------------------------------------------- redaction
from docshield.functions import redact as R  # noqa: E402


def _duck_repl(t: R.PiiType, repl: str) -> str:
    if not t.keep:
        return repl
    left, right = t.keep
    return f"\\{left}{repl}\\{right}"


def redact_type(text: str, t: R.PiiType, repl: str | None = None) -> str:
    out = text
    for _ in range(t.passes):
        out = f"regexp_replace({out}, {sql_str(t.regex)}, {sql_str(_duck_repl(t, repl or t.placeholder))}, 'g')"
    return out


def redact_names(text: str) -> str:
    names = f"regexp_extract_all({text}, {sql_str(R.TITLE_NAME)}, 2)"
    words = f"list_distinct(flatten(list_transform({names}, lambda n: regexp_split_to_array(n, '\\s+'))))"
    after = f"regexp_replace({text}, {sql_str(R.TITLE_NAME)}, {sql_str(R.NAME_PLACEHOLDER)}, 'g')"
    rx = f"{sql_str(R.WORD_L)} || w || {sql_str(R.WORD_R)}"
    rep = sql_str("\\1" + R.NAME_PLACEHOLDER + "\\2")
    step = f"regexp_replace(regexp_replace(acc, {rx}, {rep}, 'g'), {rx}, {rep}, 'g')"
    return f"list_reduce({words}, lambda acc, w: {step}, {after})"


def redact(text: str, names: bool = False) -> str:
    out = text
    for t in R.PII_TYPES:
        out = redact_type(out, t)
    if names:
        out = redact_names(out)
    return out


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def manual_word(text: str, word: str) -> str:
    """RE2 form of Python's case-insensitive ``\\b word \\b``: border classes depend on
    whether the word starts / ends with a word character; applied twice."""
    left = R.WORD_L if _is_word(word[0]) else r"([\p{L}\p{N}_])"
    right = R.WORD_R if _is_word(word[-1]) else r"([\p{L}\p{N}_])"
    rx = "(?i)" + left + re.escape(word) + right
    rep = "\\1" + R.MANUAL_PLACEHOLDER + "\\2"
    once = f"regexp_replace({text}, {sql_str(rx)}, {sql_str(rep)}, 'g')"
    return f"regexp_replace({once}, {sql_str(rx)}, {sql_str(rep)}, 'g')"


def redact_words(text: str, words: list[str]) -> str:
    out = text
    for w in words:
        if w:
            out = manual_word(out, w)
    return out


def _values(text: str, t: R.PiiType) -> str:
    """All values of one type; a rule that takes border characters is tried again on the rest."""
    once = f"regexp_extract_all({text}, {sql_str(t.regex)}, {t.group})"
    if t.passes == 1:
        return once
    rest = f"regexp_replace({text}, {sql_str(t.regex)}, {sql_str(_duck_repl(t, t.placeholder))}, 'g')"
    return f"list_concat({once}, regexp_extract_all({rest}, {sql_str(t.regex)}, {t.group}))"


def _without_earlier(text: str, t: R.PiiType) -> str:
    """The text after the types before ``t`` were taken out."""
    for earlier in R.PII_TYPES[:R.TYPE_ORDER[t.name]]:
        text = redact_type(text, earlier)
    return text


def count_type(text: str, t: R.PiiType) -> str:
    return f"CAST(len({_values(_without_earlier(text, t), t)}) AS BIGINT)"


def occurrences_cte(src: str, collection: str, doc_ord: str, text: str, name: str = "occ", names: bool = False) -> str:
    """``names``: also literal tokens and titled names (the documents hold neither)."""
    found = [(i, t.name, _values(_without_earlier(text, t), t)) for i, t in enumerate(R.PII_TYPES)]
    if names:
        found.insert(0, (-1, R.LITERAL, f"regexp_extract_all({text}, {sql_str(R.TOKEN_RE)})"))
        found.append((len(R.PII_TYPES), R.NAME, f"regexp_extract_all({redact(text)}, {sql_str(R.TITLE_NAME)})"))
    parts = []
    for i, kind, values in found:
        parts.append(
            f"SELECT collection, doc_ord, {i} AS type_ord, '{kind}' AS entity_type, "
            f"generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM "
            f"(SELECT {collection} AS collection, {doc_ord} AS doc_ord, {values} AS v FROM {src})")
    return f"{name} AS (\n" + "\nUNION ALL\n".join(parts) + "\n)"


def token_map_ctes(occ: str = "occ", name: str = "tmap", base: str | None = None) -> str:
    """first occurrence per value -> dense number per (collection, type)."""
    off = f" + coalesce((SELECT b.base FROM {base} b WHERE b.collection = n.collection AND b.entity_type = n.entity_type), 0)" if base else ""
    return f"""{name}_first AS (
  SELECT collection, entity_type, value, doc_ord, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY collection, entity_type, value ORDER BY doc_ord, pos) AS rn
    FROM {occ}) WHERE rn = 1),
{name}_num AS (
  SELECT collection, entity_type, value,
         row_number() OVER (PARTITION BY collection, entity_type ORDER BY doc_ord, pos, value) AS ord0
  FROM {name}_first),
{name} AS (
  SELECT collection, entity_type, '[' || entity_type || '_' || CAST(ord AS VARCHAR) || ']' AS token,
         value AS original, CAST(ord AS BIGINT) AS ord
  FROM (SELECT n.*, n.ord0{off} AS ord FROM {name}_num n))"""


def apply_map_ctes(occ: str, tmap: str, src: str, collection: str, doc_ord: str, text: str,
                   name: str = "tokenized") -> str:
    return f"""{name}_pairs AS (
  SELECT o.collection, o.doc_ord,
         list({{'value': o.value, 'token': m.token}} ORDER BY o.type_ord, -length(o.value), o.value) AS pairs
  FROM (SELECT DISTINCT collection, doc_ord, type_ord, entity_type, value FROM {occ}) o
  JOIN {tmap} m ON m.collection = o.collection AND m.entity_type = o.entity_type AND m.original = o.value
  GROUP BY o.collection, o.doc_ord),
{name} AS (
  SELECT s.*, coalesce(list_reduce(p.pairs, lambda acc, x: replace(acc, x.value, x.token), s.{text}), s.{text}) AS text_tokens
  FROM {src} s LEFT JOIN {name}_pairs p ON p.collection = s.{collection} AND p.doc_ord = s.{doc_ord})"""


# --------------------------------------------------------------------------- vectors / chunks
from docshield.functions import vectors as V  # noqa: E402


def bucket(tok: str, dim: int = V.HASH_DIM) -> str:
    return f"((('0x' || substr(md5({tok}), 1, 8))::BIGINT) % {dim})"


def hash_counts_cte(src: str, key: str, text: str, name: str, extra: str = "") -> str:
    """(key..., b, cnt) sparse hashing counts of ``text``; ``key`` may list several columns."""
    return f"""{name} AS (
  SELECT {key}{extra}, {bucket('tok')} AS b, count(*) AS cnt FROM (
    SELECT {key}{extra}, unnest(regexp_extract_all(lower({text}), {sql_str(V.TOKEN_RE)})) AS tok FROM {src})
  GROUP BY ALL)"""


def window_chunks_cte(src: str, text: str, size: int, overlap: int, cols: str, name: str = "chunks") -> str:
    stride = size - overlap
    n = f"(CASE WHEN length({text}) <= 0 THEN 0 ELSE 1 + CAST(ceil(greatest(length({text}) - {size}, 0) / {stride}) AS BIGINT) END)"
    return f"""{name} AS (
  SELECT * FROM (
    SELECT {cols}, CAST(i AS INTEGER) AS chunk_idx, CAST(i * {stride} AS INTEGER) AS chunk_start,
           substring({text}, CAST(i * {stride} + 1 AS BIGINT), {size}) AS chunk_text
    FROM (SELECT *, unnest(range({n})) AS i FROM {src}))
  WHERE trim(chunk_text) <> '')"""


def recursive_chunks_ctes(src: str, text: str, size: int, overlap: int, cols: str, name: str = "chunks") -> str:
    """C1 in SQL (``WITH RECURSIVE``): a tree of pieces, cut at the first separator that a piece holds;
    neighbouring short pieces of one parent form a group; from a group's prefix sums each chunk follows
    from the one before.  ``cols`` must name a row of ``src``.  Written from the splitter's rule, not
    from the engine's code: one step a chunk instead of one a piece."""
    nl = "chr(10)"
    seps = [f"{nl} || {nl}", nl, "' '", "''"]
    sep_no = " ".join(f"WHEN level <= {i} AND contains(piece, {x}) THEN {i}" for i, x in enumerate(seps[:3]))
    parts = " ".join(f"WHEN {i} THEN list_transform(string_split(piece, {x}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {x} || p END)"
                     for i, x in enumerate(seps))
    blank = "[ \\t\\n\\v\\f\\r]"

    def stop(st: str, at: str) -> str:  # the first piece from ``at`` on that no longer fits behind ``st``
        return f"list_filter(range({at}, len(ps) - 1), lambda x: ps[x + 2] - ps[{st} + 1] > {size})[1]"

    held = "(ps[j + 1] - ps[x + 1])"
    start = (f"list_filter(range(st, j + 1), lambda x: {held} <= {overlap} "
             f"AND ({held} + ps[j + 2] - ps[j + 1] <= {size} OR {held} = 0))[1]")
    return f"""{name}_tree AS (
  SELECT {cols}, CAST([] AS BIGINT[]) AS parent, CAST(0 AS BIGINT) AS idx, {text} AS piece, 0 AS level, TRUE AS deeper FROM {src}
  UNION ALL
  SELECT {cols}, list_append(parent, idx), i, p, sep + 1, length(p) >= {size} AND sep < 3
  FROM (SELECT {cols}, parent, idx, sep, unnest(parts) AS p, CAST(generate_subscripts(parts, 1) AS BIGINT) AS i
        FROM (SELECT *, list_filter(CASE sep {parts} END, lambda p: p <> '') AS parts
              FROM (SELECT *, CASE {sep_no} ELSE 3 END AS sep FROM {name}_tree WHERE deeper)))),
{name}_groups AS (
  SELECT {cols}, min(list_append(parent, idx)) AS place, string_agg(piece, '' ORDER BY idx) AS txt,
         list_concat([0], list(upto ORDER BY idx)) AS ps
  FROM (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY {cols}, parent, breaks ORDER BY idx) AS BIGINT) AS upto
        FROM (SELECT *, sum(CASE WHEN deeper THEN 1 ELSE 0 END) OVER (PARTITION BY {cols}, parent ORDER BY idx) AS breaks
              FROM {name}_tree WHERE len(parent) > 0)
        WHERE NOT deeper)
  GROUP BY {cols}, parent, breaks),
{name}_steps AS (
  SELECT {cols}, place, txt, ps, CAST(0 AS BIGINT) AS st, {stop('0', '0')} AS j, 0 AS k FROM {name}_groups
  UNION ALL
  SELECT {cols}, place, txt, ps, st2, {stop('st2', 'j')}, k + 1
  FROM (SELECT *, {start} AS st2 FROM {name}_steps WHERE j IS NOT NULL)),
{name} AS (
  SELECT {cols}, CAST(row_number() OVER (PARTITION BY {cols} ORDER BY place, k) - 1 AS INTEGER) AS chunk_idx, CAST(NULL AS INTEGER) AS chunk_start, chunk_text
  FROM (SELECT {cols}, place, k, regexp_replace(substring(txt, ps[st + 1] + 1, ps[coalesce(j, len(ps) - 1) + 1] - ps[st + 1]),
                                             '^{blank}+|{blank}+$', '', 'g') AS chunk_text FROM {name}_steps)
  WHERE chunk_text <> '')"""


# --------------------------------------------------------------------------- chat
from docshield.functions import chat as CH  # noqa: E402

WS = "[ \\t\\n\\r\\f]"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_quotes(x: str) -> str:
    return f"regexp_replace({x}, '^[\"'']+|[\"'']+$', '', 'g')"


def best_sentence(question: str, texts: str) -> str:
    def terms(x: str) -> str:
        return f"list_distinct(regexp_extract_all(lower({x}), {sql_str(V.TOKEN_RE)}))"

    shared = f"len(list_intersect({terms(question)}, {terms('s')}))"
    score = f"(1000 * {shared} * {shared}) // greatest(len({terms('s')}), 1)"
    cut = f"regexp_extract_all(x, {sql_str(CH.SENTENCE_RE)})"
    strip = strip_ws("y")
    sentences = (f"flatten(list_transform({texts}, lambda x, r: list_transform(list_transform({cut}, lambda y: {strip}), "
                 f"lambda s, i: {{'score': {score}, 'rank': -r, 'place': -i, 's': s}})))")
    best = f"(list_reverse_sort({sentences}))[1]"
    return (f"(SELECT CASE WHEN b.score > 0 THEN b.s ELSE {sql_str(CH.NO_CONTEXT_ANSWER)} END FROM (SELECT {best} AS b))")


def k_for(host: str, model: str) -> str:
    conds = ([f"contains(lower(coalesce({host}, '')), {sql_str(h)})" for h in V.CLOUD_HOSTS] +
             [f"contains(lower(coalesce({model}, '')), {sql_str(m)})" for m in V.CLOUD_MODEL_MARKERS])
    return f"(CASE WHEN {' OR '.join(conds)} THEN {V.K_CLOUD} ELSE {V.K_LOCAL} END)"


def parse_questions(text: str) -> str:
    t = strip_ws(f"coalesce({text}, '')")
    start = f"instr({t}, '[')"
    rpos = f"instr(reverse({t}), ']')"
    end = f"(length({t}) - {rpos} + 1)"
    js = f"(CASE WHEN {start} > 0 AND {rpos} > 0 AND {end} > {start} THEN substring({t}, {start}, {end} - {start} + 1) END)"
    parsed = (f"(CASE WHEN json_valid({js}) AND json_type({js}) = 'ARRAY' "
              f"THEN from_json({js}, '[\"VARCHAR\"]') END)")
    cleaned = f"list_filter(list_transform({parsed}, lambda x: {strip_ws('x')}), lambda x: x IS NOT NULL AND x <> '')"
    json_q = f"(CASE WHEN len({cleaned}) > 0 THEN {cleaned}[1:3] END)"
    lines = f"string_split({t}, chr(10))"
    bullet = sql_str(CH.BULLET_RE)
    p1 = (f"(list_filter(list_transform({lines}, lambda l: {strip_quotes(strip_ws(f'regexp_replace({strip_ws(chr(108))}, {bullet}, {chr(39)}{chr(39)})'))}), "
          f"lambda x: length(x) > 10 AND ends_with(x, '?')))[1:3]")
    c2 = f"list_filter(list_transform({lines}, lambda l: {strip_quotes(strip_ws('l'))}), lambda x: x <> '' AND ends_with(x, '?'))"
    p2 = (f"list_filter(list_filter({c2}, lambda x, i: NOT list_contains(({c2})[1:i - 1], x)), "
          f"lambda x: NOT list_contains({p1}, x))")
    lined = f"(list_concat({p1}, {p2}))[1:3]"
    defaults = "[" + ", ".join(sql_str(q) for q in CH.DEFAULT_QUESTIONS) + "]"
    return f"coalesce({json_q}, CASE WHEN len({lined}) > 0 THEN {lined} ELSE {defaults} END)"
