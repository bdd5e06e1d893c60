r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score. DataFrame operations alone.

Base kinds (leftmost non-overlapping matches, failing ones dropped without a retry): ``email``, ``ip`` (parts at most
255), ``card`` (12 to 19 digits that pass Luhn), ``phone`` (9 to 15 digits). The method adds ``iban`` (mod-97 is 1): every
start with a registered country code is tried at that country's length, so words and digits behind a number don't hide it;
with other codes the whole run of capitals and digits is tried. It also adds ``secret`` (a run of at least 20 letters, digits
and ``+/_=-`` that begins like a known kind of key, or has letters, digits, an entropy of at least ``LEAST_ENTROPY`` bits a
character and a context word nearby) and ``jwt`` (three encoded parts of which two begin as JSON does).

The patterns here are the stated ones in a form that takes linear time on long runs and no stack for each repetition:
a start inside a run of the first class cannot succeed where the start of the run failed, so a look-behind (or the end
of the match before) skips it; numbers with single separators are found after separators that touch another one
are overwritten, by as many characters, so offsets stay.

Offsets are code points: the matches of a pattern and the pieces between them alternate, and their lengths are summed up
in blocks, so a text with very many matches costs no square.

Score: a percentage by kind, raised if a context word of the kind stands within ``CONTEXT`` code points, lowered
otherwise. It grades spans and drops none but long runs that only their context would make secrets.

Edge cases: a null or empty text has no spans. Null ids and repeated rows are kept as rows. An empty table gives an empty
result. The rows stand in one struct while the work goes on beside them, so their columns may have any names; a column
``pii_spans`` gives way to the new one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import let
from tessella.llm.common import table

CONTEXT = 40
BLOCK = 256
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "jwt")
LEAST_ENTROPY = 3.0
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9][0-9\x20-]*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "secret": r"[A-Za-z0-9+/_=-]{20,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
#: Beginnings of known kinds of keys.
KNOWN_KEYS = r"^(?:AKIA|ASIA|AIza|gh[opsu]_|glpat-|xox[abps]-|sk-)"
#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 33: "RU", 32: "LC",
}
_REGISTERED = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
_OTHER = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')}){PATTERNS['iban'][2:-2]}"
#: A start of an account number; its group 1 is the whole number.
IBAN_START = rf"\b(?=((?:{_REGISTERED}|{_OTHER})\b))[A-Z]{{2}}[0-9]{{2}}"
#: A cheap necessary condition of each kind.
NEEDS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{10,}[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}
#: Words of which a text with secrets has one, in lower case; they are looked for one by one, which is far cheaper than a pattern of all.
SECRET_WORDS = "token secret passw pwd key auth bearer credential asia akia aiza gho_ ghp_ ghs_ ghu_ glpat- xox sk-".split()
#: Patterns as they run: a run of the characters is tried at its start alone.
RUNS = PATTERNS | {"secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"}
#: Percent without and with a context word, and the words.
GRADES = {
    "email": (80, 95, r"mail|contact|write|reply"),
    "ip": (50, 80, r"\bip\b|address|host|server|login"),
    "card": (70, 95, r"card|visa|master|credit|debit|paid|payment"),
    "phone": (60, 90, r"phone|tel|call|mobile|fax|cell"),
    "iban": (80, 95, r"iban|bank|account|konto|transfer"),
    "secret": (60, 90, r"token|secret|passw|pwd|key|auth|bearer|credential"),
    "jwt": (80, 95, r"token|auth|bearer|jwt"),
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(number: Column) -> Column:
    """The remainder by 97 of an account number after its first four characters have moved to its end, letters from 10."""
    turned = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c >= "A", (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    n = F.length(text)

    def weighted(s: Column, c: Column) -> Column:
        k = (n - F.length(F.replace(text, c, F.lit("")))).cast("double")
        return s + k * F.log2(k)

    return F.log2(n.cast("double")) - F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: F.when(c == "", s).otherwise(weighted(s, c))) / n


def _passes(kind: str, match: Column, near: Column) -> Column:
    """Whether a match is confirmed; ``near``: whether a context word stands nearby."""
    if kind in ("email", "jwt"):
        return F.lit(True)
    if kind == "secret":
        mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]") & near
        return F.when(match.rlike(KNOWN_KEYS), True).when(mixed, entropy(match) >= LEAST_ENTROPY).otherwise(False)
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    number = F.translate(match, " ", "")
    return F.when(F.length(number).between(15, 34), mod97(number) == 1).otherwise(False)


def _starts(gaps: Column, matches: Column) -> Column:
    """Offsets of the matches: gap 1, match 1, gap 2, ... in order; sums within blocks, then over blocks."""
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m")))
    return let(steps, _summed)


def _summed(steps: Column) -> Column:
    def block(first: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            F.slice(steps, first, BLOCK),
            none,
            lambda s, x: F.struct(
                (s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["g"])).alias("starts")
            ),
        )

    blocks = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK)), block)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all"))
    summed = F.aggregate(
        blocks,
        none,
        lambda s, b: F.struct(
            (s["at"] + b["at"]).alias("at"),
            F.concat(s["all"], F.array(F.transform(b["starts"], lambda x: x + s["at"]))).alias("all"),
        ),
    )
    return F.flatten(summed["all"])


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: structs (start, rank, stop, kind, match, score) by start, then kind as listed."""
    of = F.col("text")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    for kind in KINDS:
        source = of
        if kind == "card":
            source = F.regexp_replace(of, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "x")
        pattern = IBAN_START if kind == "iban" else RUNS[kind]
        heads = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
        if kind == "secret":
            has = let(F.lower(of), lambda low: reduce(or_, (low.contains(w) for w in SECRET_WORDS)))
        else:
            has = of.contains({"email": "@", "jwt": "eyJ"}[kind]) if kind in ("email", "jwt") else of.rlike(NEEDS[kind])
        found = found.withColumn(kind, F.when(has, F.regexp_extract_all(source, F.lit(pattern), F.lit(1)) if kind == "iban" else heads))
        some = F.size(kind) > 0
        found = found.withColumn(f"{kind}_at", F.when(some, _starts(F.split(source, pattern, -1), heads if kind == "iban" else F.col(kind))))

    def graded(kind: str) -> Column:
        low, high, words = GRADES[kind]

        def span(match: Column, i: Column) -> Column:
            start = F.col(f"{kind}_at")[i]
            stop = start + F.length(match)
            left = F.greatest(start - CONTEXT, F.lit(0))
            near = F.concat_ws(" ", F.substring(of, left + 1, start - left), F.substring(of, stop + 1, F.lit(CONTEXT)))
            return F.struct(
                start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"),
                match.alias("match"), F.when(F.lower(near).rlike(words), high).otherwise(low).alias("score"),
            )

        spans = F.transform(kind, span)
        return F.when(F.size(kind) > 0, F.filter(spans, lambda s: _passes(kind, s["match"], s["score"] == high)))

    kind_of = "array<struct<start:int,rank:int,stop:int,kind:string,match:string,score:int>>"
    every = F.concat(*[F.coalesce(graded(k), F.array().cast(kind_of)) for k in KINDS])
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "pii_spans"]
    return found.select("row", F.array_sort(every).alias("pii_spans")).select(*kept, "pii_spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    spans = F.aggregate(
        "pii_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
            F.struct(
                x["stop"].alias("at"),
                F.concat(s["out"], F.substring("text", s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"),
            )
        ),
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = find_spans(docs.select(row, F.col(f"`{text_col}`").alias("text"))).withColumn("cut", spans)
    clean = F.concat(F.col("cut.out"), F.substring("text", F.col("cut.at") + 1, F.length("text")))
    return found.select("row", clean.alias("clean")).select(*[F.col("clean" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(_listed(F.filter("pii_spans", lambda s: s["rank"] < 4)), 256).alias("base_sha256"),
        _listed(F.col("pii_spans")).alias("spans"),
        *[count(k) for k in KINDS[4:]],
        F.size("pii_spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _sql_kind(kind: str, pattern: str, source: str, passes: str) -> str:
    return f"""
    select row_id, start, {KINDS.index(kind)} as rank, start + length(m) as stop, '{kind}' as kind, m from (
        select row_id, m, (sum(length(g) + length(m)) over (partition by row_id order by i) - length(m))::bigint as start from (
            select row_id, unnest(regexp_extract_all({source}, '{pattern}')) as m, unnest(regexp_split_to_array({source}, '{pattern}')[:-2]) as g,
                generate_subscripts(regexp_extract_all({source}, '{pattern}'), 1) as i
            from texts where regexp_matches({source}, '{pattern}')))
    where {passes}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) between 12 and 19 and list_sum(list_transform(range(1, length({_DIGITS}) + 1),
    lambda i: case when i % 2 = 1 then {_DIGITS}[length({_DIGITS}) - i + 1]::int
    else (2 * {_DIGITS}[length({_DIGITS}) - i + 1]::int) // 10 + (2 * {_DIGITS}[length({_DIGITS}) - i + 1]::int) % 10 end)) % 10 = 0"""
_IBAN = """length(replace(m, ' ', '')) between 15 and 34 and (array_to_string(list_transform(
    string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''),
    lambda c: case when c >= 'A' then (ord(c) - 55)::varchar else c end), ''))::decimal(38, 0) % 97 = 1"""
_NEAR = "lower(concat_ws(' ', substr(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)), substr(text, stop + 1, 40)))"
_SCORE = " ".join(f"when kind = '{k}' then case when regexp_matches({_NEAR}, '{w}') then {b} else {a} end" for k, (a, b, w) in GRADES.items())
OP10_SQL = f"""
with texts as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
spans as (
    {_sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "text", "true")}
    union all
    {_sql_kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "text", "list_max(list_transform(string_split(m, '.'), lambda p: p::decimal(38, 0))) <= 255")}
    union all
    {_sql_kind("card", r"[0-9]([\x20-]?[0-9])+", "text", _LUHN)}
    union all
    {_sql_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "text", f"length({_DIGITS}) between 9 and 15")}
    union all
    {_sql_kind("iban", PATTERNS["iban"], "text", _IBAN)}
    union all
    {_sql_kind("secret", PATTERNS["secret"], "text", "true")}
    union all
    {_sql_kind("jwt", PATTERNS["jwt"], "text", "true")}
), scored as (
    select s.*, case {_SCORE} end as score from spans s join texts using (row_id)
), graded as (
    select * from scored where kind <> 'secret' or regexp_matches(m, '{KNOWN_KEYS}') or (score = {GRADES["secret"][1]} and regexp_matches(m, '[0-9]')
        and regexp_matches(m, '[A-Za-z]') and list_aggregate(string_split(m, ''), 'entropy') >= {LEAST_ENTROPY})
), joined as (
    select row_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
        count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone, count(*) filter (kind = 'iban') as n_iban,
        count(*) filter (kind = 'secret') as n_secret, count(*) filter (kind = 'jwt') as n_jwt, count(*) as n_spans,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 4) as base,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans,
        string_agg(score::varchar, ',' order by start, rank) as scores
    from graded group by row_id
)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
    coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
    coalesce(scores, '') as scores, coalesce(n_iban, 0) as n_iban, coalesce(n_secret, 0) as n_secret, coalesce(n_jwt, 0) as n_jwt, coalesce(n_spans, 0) as n_spans
from texts left join joined using (row_id)
"""
