"""Personal data: format-preserving Feistel pseudonyms (SQL functions only).

Candidates are found with one pattern per text and checked one by one: card numbers by Luhn's digit,
account numbers (IBAN) by their check digits, dates by the calendar, addresses by their octets,
social security numbers by their ranges.  What passes is permuted inside its own format with a
keyed Feistel network over two halves,

    left = (left + f(right)) mod a,    right = (right + f(left)) mod b,    f = keyed SHA-256,

a bijection of a x b values: digits go to digits of the same layout, a valid card number to a valid
one, a date to a date in the same notation.  Where a domain is not a x b values, the network is
applied again until the value is inside it (cycle walking), which stays a bijection.  E-mail names
and hexadecimal secrets, which are no numbers, get keyed pseudonyms of their own format.  The same
value always gets the same pseudonym, in any layout and any document; without the key it tells
nothing.  What fails its check stays as it is; a run of digits that fails Luhn as a whole is searched for
a valid card in a card's layout between its group borders (one followed by a security code or a date).

Everything is a projection: no shuffle, no UDF, one pass over the text.  Patterns have bounded
repeats, so very long texts cost time in proportion.

Defined results: null text counts as empty; texts without candidates come back unchanged; values
that touch letters or digits are no candidates (but a date before a time, 2001-02-03T04:05, is one);
extra columns of any name are ignored, or carried by ``protected``; repeated rows give equal results; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, pack, pick, text_of

ROUNDS = 10
#: Stands in where the caller names no key (tests, the registered query); keep a real one secret.
KEY = "docshield-example-key"

_EDGE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
#: Candidates, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}" + _END,
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?!(?!T[0-9]{2}:)[\p{L}\p{N}/-]|\.[0-9])",
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}]|[.-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}]|-[0-9])",
    "secret": _EDGE + r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})" + _END,
}
CANDIDATE = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Layouts of a card inside a longer run of digit groups.
CARD_LAYOUT = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: The country calling codes, none of which begins another (other codes have three digits).
COUNTRY = r"^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: What any candidate holds; texts without it are not searched further.
HINT = r"[0-9]{3}|@|[0-9][./][0-9]|[0-9a-fA-F]{32}"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Sql:
    """SQL text of the pseudonym of a candidate ``m`` under a key; lambda names never repeat."""

    def __init__(self, key: str):
        self.key, self.count = _quote(key), 0

    def name(self, stem: str) -> str:
        self.count += 1
        return f"{stem}{self.count}"

    def mac(self, *parts: str) -> str:
        return f"sha2(concat_ws('|', {', '.join([self.key, *parts])}), 256)"

    def feistel(self, left: str, right: str, a: str, b: str, kind: str) -> str:
        """named_struct(l, r) of the permuted pair."""
        s, i = self.name("s"), self.name("i")

        def f(x: str) -> str:
            return f"cast(conv(substr({self.mac(_quote(kind), f'cast({i} as string)', f'cast({x} as string)')}, 1, 15), 16, 10) as bigint)"

        return (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', {left}, 'r', {right}), ({s}, {i}) -> "
                f"CASE WHEN {i} % 2 = 0 THEN named_struct('l', pmod({s}.l + {f(f'{s}.r')}, {a}), 'r', {s}.r) "
                f"ELSE named_struct('l', {s}.l, 'r', pmod({s}.r + {f(f'{s}.l')}, {b})) END)")

    def let(self, value: str, body) -> str:
        """``body`` with a name for ``value``, worked out once."""
        x = self.name("x")
        return f"get(transform(array({value}), {x} -> {body(x)}), 0)"

    def walk(self, value: str, step, inside) -> str:
        """step(value), applied again until inside(...); the bound is never met in practice."""
        x, k = self.name("x"), self.name("k")
        return f"aggregate(sequence(1, 200), {step(value)}, ({x}, {k}) -> CASE WHEN {inside(x)} THEN {x} ELSE {step(x)} END)"

    def digits(self, d: str, kind: str) -> str:
        """A digit string of 2 to 20 digits, permuted among those of its length."""
        def run(d: str) -> str:
            u = f"cast(length({d}) div 2 as int)"
            v = f"(length({d}) - {u})"
            ten = "cast(rpad('1', {} + 1, '0') as bigint)".format
            pair = self.feistel(f"cast(left({d}, {u}) as bigint)", f"cast(right({d}, {v}) as bigint)", ten(u), ten(v), kind)
            return self.let(pair, lambda p: f"concat(lpad(cast({p}.l as string), {u}, '0'), lpad(cast({p}.r as string), {v}, '0'))")

        return self.let(d, run)

    def only_digits(self, m: str) -> str:
        return f"regexp_replace({m}, '[^0-9]', '')"

    def laid_out(self, m: str, digits: str) -> str:
        """The layout of ``m`` with other digits in place of its own."""
        i = self.name("i")
        ch = f"substr({m}, {i}, 1)"
        nth = f"length({self.only_digits(f'substr({m}, 1, {i})')})"
        return self.let(digits, lambda d: f"array_join(transform(sequence(1, length({m})), {i} -> "
                                          f"CASE WHEN {ch} rlike '[0-9]' THEN substr({d}, {nth}, 1) ELSE {ch} END), '')")

    def luhn(self, d: str) -> str:
        """Luhn's sum of a digit string modulo 10."""
        a, i = self.name("a"), self.name("i")
        x = f"cast(substr({d}, length({d}) + 1 - {i}, 1) as int)"
        return (f"aggregate(sequence(1, length({d})), 0, ({a}, {i}) -> {a} + CASE WHEN {i} % 2 = 1 THEN {x} "
                f"WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END) % 10")

    def card(self, m: str) -> str:
        def made(d: str, c: str) -> str:
            body = self.digits(f"left({d}, length({d}) - 1)", "card")
            full = self.let(body, lambda b: f"concat({b}, cast((10 - {self.luhn(f'concat({b}, {_quote(str(0))})')}) % 10 as string))")
            return f"CASE WHEN {self.luhn(d)} = 0 AND {d} rlike '[1-9]' THEN {self.laid_out(c, full)} END"

        def put(c: str) -> str:
            return self.let(self.only_digits(c), lambda d: made(d, c))

        p, e, x = self.name("p"), self.name("e"), self.name("x")
        starts = f"filter(sequence(1, length({m})), {p} -> concat(' ', substr({m}, 1, {p})) rlike '[ -][0-9]$')"
        ends = f"filter(sequence(length({m}), 1), {e} -> concat(substr({m}, {e}), ' ') rlike '^[0-9][ -]')"
        p2, e2 = self.name("p"), self.name("e")
        parts = f"flatten(transform({starts}, {p2} -> transform({ends}, {e2} -> named_struct('p', {p2}, 'c', substr({m}, {p2}, greatest({e2} - {p2} + 1, 0))))))"
        valid = (f"CASE WHEN {x}.c rlike {_quote(CARD_LAYOUT)} THEN {self.let(self.only_digits(f'{x}.c'), self.luhn)} = 0 "
                 f"AND {x}.c rlike '[1-9]' ELSE false END")
        inner = self.let(f"get(filter({parts}, {x} -> {valid}), 0)", lambda f: (
            f"concat(substr({m}, 1, {f}.p - 1), {put(f'{f}.c')}, substr({m}, {f}.p + length({f}.c)))"))
        return f"coalesce({put(m)}, CASE WHEN {m} rlike '[ -]' THEN {inner} END)"

    def ssn(self, m: str) -> str:
        def valid(d: str) -> str:
            return f"({d} rlike '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$')"

        return self.let(self.only_digits(m), lambda d: f"CASE WHEN {valid(d)} THEN " + self.laid_out(
            m, self.walk(d, lambda x: self.digits(x, "ssn"), valid)) + " END")

    def phone(self, m: str) -> str:
        """The country code stays; the national digits are permuted, so that all layouts of a number,
        with and without its code, stay linked."""
        def made(rest: str) -> str:
            return f"concat(left({m}, length({m}) - length({rest})), {self.laid_out(rest, self.digits(self.only_digits(rest), 'phone'))})"

        return self.let(f"regexp_replace({m}, {_quote(COUNTRY)}, '')", made)

    def ip(self, m: str) -> str:
        def made(o: str) -> str:
            part = [f"cast({o}[{k}] as bigint)" for k in range(4)]
            pair = self.feistel(f"{part[0]} * 256 + {part[1]}", f"{part[2]} * 256 + {part[3]}", "65536", "65536", "ip")
            text = self.let(pair, lambda p: f"concat_ws('.', cast({p}.l div 256 as string), cast({p}.l % 256 as string), "
                                            f"cast({p}.r div 256 as string), cast({p}.r % 256 as string))")
            x = self.name("x")
            return f"CASE WHEN forall({o}, {x} -> cast({x} as int) < 256) THEN {text} END"

        return self.let(f"split({m}, '[.]')", made)

    def date(self, m: str) -> str:
        """Days from 1900 to 2099, in the notation of ``m`` (day first, else month first)."""
        base, last = "date'1900-01-01'", 73048  # fixed: days between the first and the last date

        def moved(n: str) -> str:
            pair = self.feistel(f"cast({n} div 270 as bigint)", f"cast({n} % 270 as bigint)", "271", "270", "date")
            return self.let(pair, lambda p: f"cast({p}.l * 270 + {p}.r as int)")

        def in_notation(notation: str, otherwise: str) -> str:
            def made(n: str) -> str:
                day = f"date_add({base}, {self.walk(n, moved, lambda x: f'{x} <= {last}')})"
                return f"CASE WHEN {n} BETWEEN 0 AND {last} THEN date_format({day}, {_quote(notation)}) END"

            parsed = f"cast(try_to_timestamp({m}, {_quote(loose(notation))}) as date)"
            return f"coalesce({self.let(f'datediff({parsed}, {base})', made)}, {otherwise})"

        def loose(notation: str) -> str:
            return notation.replace("dd", "d").replace("MM", "M") if notation[0] != "y" else notation

        def either(sign: str) -> str:
            return in_notation(f"dd{sign}MM{sign}yyyy", in_notation(f"MM{sign}dd{sign}yyyy", "NULL"))

        return (f"CASE WHEN {m} rlike '^[0-9]{{4}}' THEN {in_notation('yyyy-MM-dd', 'NULL')} "
                f"WHEN contains({m}, '/') THEN {either('/')} ELSE {either('.')} END")

    def mod97(self, s: str) -> str:
        """The remainder of an account number, letters read as two digits."""
        a, i = self.name("a"), self.name("i")
        c = f"substr({s}, {i}, 1)"
        value = f"CASE WHEN {c} rlike '[0-9]' THEN cast({c} as int) ELSE ascii({c}) - 55 END"
        return (f"aggregate(sequence(1, length({s})), 0, ({a}, {i}) -> "
                f"({a} * CASE WHEN {c} rlike '[0-9]' THEN 10 ELSE 100 END + {value}) % 97)")

    def iban(self, m: str) -> str:
        def made(s: str) -> str:
            rest = f"substr({s}, 5)"
            body = self.laid_out(rest, self.halves(self.only_digits(rest), "iban"))

            def full(b: str) -> str:
                check = f"lpad(cast(98 - {self.mod97(f'concat({b}, left({s}, 2), {_quote(str(0) * 2)})')} as string), 2, '0')"
                return self.spaced(m, self.let(check, lambda c: f"concat(left({s}, 2), {c}, {b})"))

            return f"CASE WHEN {self.mod97(f'concat({rest}, left({s}, 4))')} = 1 THEN {self.let(body, full)} END"

        return self.let(f"replace({m}, ' ', '')", made)

    def halves(self, d: str, kind: str) -> str:
        """Any digit string: runs of up to 18 digits, each permuted, one with the other's tweak."""
        first = f"left({d}, 18)"
        return (f"concat(CASE WHEN length({d}) < 2 THEN {d} ELSE {self.digits(first, kind)} END, "
                f"CASE WHEN length({d}) <= 18 THEN '' WHEN length({d}) = 19 THEN right({d}, 1) "
                f"ELSE {self.digits(f'substr({d}, 19)', kind + '2')} END)")

    def spaced(self, m: str, s: str) -> str:
        """The characters of ``s`` with the spaces of ``m``."""
        i = self.name("i")
        nth = f"length(replace(substr({m}, 1, {i}), ' ', ''))"
        return self.let(s, lambda t: f"array_join(transform(sequence(1, length({m})), {i} -> "
                                     f"CASE WHEN substr({m}, {i}, 1) = ' ' THEN ' ' ELSE substr({t}, {nth}, 1) END), '')")

    def email(self, m: str) -> str:
        return f"concat('u', left({self.mac(_quote('email'), f'lower({m})')}, 11), substr({m}, instr({m}, '@')))"

    def secret(self, m: str) -> str:
        long = f"left(concat({self.mac(_quote('secret'), m)}, {self.mac(_quote('secret2'), m)}), length({m}))"
        return f"CASE WHEN {m} rlike '[A-F]' THEN upper({long}) ELSE {long} END"

    def kind(self, m: str) -> str:
        """Which pattern made a candidate."""
        return (f"CASE WHEN contains({m}, '@') THEN 'email' WHEN {m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
                f"|[0-9]{{1,2}}([/.])[0-9]{{1,2}}\\\\2[0-9]{{4}})$' THEN 'date' WHEN {m} rlike '^[A-Z]{{2}}[0-9]{{2}}[ A-Z0-9]{{11,}}$' "
                f"AND NOT {m} rlike '^[0-9A-F]{{32,64}}$' THEN 'iban' "
                f"WHEN {m} rlike '^([+(]|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$)' THEN 'phone' "
                f"WHEN {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn' WHEN {m} rlike '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' THEN 'ip' "
                f"WHEN {m} rlike '^[0-9](?:[ -]?[0-9]){{12,18}}$' THEN 'card' ELSE 'secret' END")

    def pseudonym(self, m: str) -> str:
        """named_struct(kind, value); the value is null for a candidate that fails its check."""
        def made(k: str) -> str:
            cases = " ".join(f"WHEN '{kind}' THEN {getattr(self, kind)(m)}" for kind in PATTERNS)
            return f"named_struct('kind', {k}, 'value', CASE {k} {cases} END)"

        return self.let(self.kind(m), made)


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY, make=pick, **cols) -> DataFrame:
    """Adds ``clean`` (the text with pseudonyms) and ``kinds`` (kinds of what was replaced)."""
    body = text_of(docs, text)
    rows = make(docs, body=body, **cols)
    hits = F.when(F.col("body").rlike(HINT), F.regexp_extract_all("body", F.lit(CANDIDATE), F.lit(0)))
    rows = rows.withColumn("hits", F.coalesce(hits, F.array().cast("array<string>")))
    sql = _Sql(key)
    rows = rows.withColumn("made", F.expr(f"transform(hits, m -> {sql.pseudonym('m')})"))
    gaps = F.split("body", CANDIDATE, -1)
    put = F.expr("zip_with(hits, made, (h, p) -> coalesce(p.value, h))")
    whole = F.array_join(F.zip_with(gaps, put, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    rows = rows.withColumn("clean", F.when(F.size("hits") > 0, whole).otherwise(F.col("body")))
    return rows.withColumn("kinds", F.expr("transform(filter(made, p -> p.value IS NOT NULL), p -> p.kind)"))


def protect(docs: DataFrame, text: str = "text", doc: str = "doc_id", key: str = KEY) -> DataFrame:
    """One row per document: doc_id, text (with pseudonyms), n_replaced, kinds (distinct, sorted)."""
    rows = pseudonymised(docs, text, key, pick, doc_id=docs[doc].cast("long"))
    return rows.select("doc_id", F.col("clean").alias("text"), F.size("kinds").alias("n_replaced"),
                       F.array_sort(F.array_distinct("kinds")).alias("kinds"))


def protected(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """The input rows with pseudonyms in their text (columns as given; null text stays null)."""
    rows = pseudonymised(docs, text, key, pack)
    new = F.when(F.col(ROW)[text].isNotNull(), F.col("clean"))
    return rows.select(*[new.alias(c) if c == text else F.col(ROW)[c].alias(c) for c in docs.columns])
