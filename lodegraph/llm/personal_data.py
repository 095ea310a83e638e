"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from the four base patterns (email, ip, card, phone; their matches that pass their own
test always stay) and from loose patterns (masked addresses, account numbers, national ids, phones without
a plus). Three labelers vote on each candidate: its format, gazetteers of domains and prefixes, and the words
before it. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is
and how likely each candidate is personal data; a logistic classifier over kind, votes and length is trained
on these and decides on the loose candidates. The counts are one row for each pattern of votes, a bounded
number whatever the input; the executors work on expressions alone.

Offsets are code points, ends exclusive. Nulls: a null text is an empty one. Repeated rows are done one by
one, an empty table gives no rows; columns besides doc_id and text are ignored by digest() and kept by redact(), whatever
they are called. Spans of one kind never overlap, so they have no ties. Patterns are written so that the regex engine neither recurses nor
rescans, however long the text: a separator inside a number, or a dot inside a domain, first becomes one private-use
character.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, texts

BASE = ("email", "ip", "card", "phone")
LOOSE = ("address", "account", "identity", "number")
#: A candidate is added that is likelier than this to be personal data.
ACCEPT = 0.5
#: A joined separator; a text that holds the character itself gets _OTHER in its place, which no pattern takes either.
_MARK, _OTHER = "\ue000", "\ue001"
_BLOCK = 256

_EMAIL = f"(?:\\G|(?<![A-Za-z0-9._%+{_MARK}-]))[A-Za-z0-9._%+{_MARK}-]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = f"[0-9][0-9{_MARK}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+(?: ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]{1,63}+(?:(?: ?\(dot\) ?| ?\[dot\] ?|\.)[A-Za-z0-9-]{1,63}+){1,4}"
_ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NUMBER = r"(?<![0-9+().-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ /.-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9-])"

# Fixed values of the gazetteers and of the words that speak for or against.
DOMAINS = "com org net edu gov int info biz io co de fr es uk us eu at ch nl be it pt br mx ar ca au"
COUNTRIES = "DE FR ES GB AT CH NL BE IT PT LU IE SE DK NO FI PL CZ"
FOR = "mail contact kontakt contacto correo courriel tel phone call mobile fax ruf anruf téléphone teléfono móvil handy server host address adresse dirección card visa karte carte tarjeta iban account konto compte cuenta ssn"
AGAINST = "version isbn issn doi order ref invoice chapter section page seite figure fig table release build"

SPAN = "array<struct<kind: string, s: bigint, e: bigint, pattern: string>>"


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\'") + "'" if "\\" in text else "'" + text + "'"


def _words(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _matches(df: DataFrame, text: str, pattern: str, name: str, where: str) -> DataFrame:
    """Adds the matches, what stands between them, and each one's start. Starts are prefix sums, in blocks so that many matches don't cost their square."""
    m, p, d, b, s = (f"_{x}_{name}" for x in "mpdbs")
    df = df.withColumn(m, F.expr(f"case when {where} then regexp_extract_all({text}, {_sql(pattern)}, 0) else cast(array() as array<string>) end"))
    df = df.withColumn(p, F.expr(f"case when size({m}) > 0 then split({text}, {_sql(pattern)}, -1) end"))
    df = df.withColumn(d, F.expr(f"case when size({p}) = size({m}) + 1 then transform({m}, (x, i) -> cast(char_length({p}[i]) + if(i > 0, char_length({m}[i - 1]), 0) as bigint)) when size({m}) > 0 then raise_error('{name}: matches and what stands between them differ in number') else cast(array() as array<bigint>) end"))
    df = df.withColumn(b, F.expr(f"case when size({d}) > 0 then transform(sequence(0, (size({d}) - 1) div {_BLOCK}), j -> aggregate(slice({d}, cast(j * {_BLOCK} as int) + 1, {_BLOCK}), 0L, (a, x) -> a + x)) else cast(array() as array<bigint>) end"))
    block = f"cast(i div {_BLOCK} as int)"
    return df.withColumn(s, F.expr(f"case when size({b}) > 0 then transform({d}, (x, i) -> aggregate(slice({b}, 1, {block}), 0L, (a, y) -> a + y) + aggregate(slice({d}, {block} * {_BLOCK} + 1, i % {_BLOCK} + 1), 0L, (a, y) -> a + y)) else cast(array() as array<bigint>) end"))


def _spans(name: str, kind: str, ok: str, pattern: str) -> str:
    """Spans of the matches x that pass, with their vote pattern."""
    made = f"transform(_m_{name}, (x, i) -> named_struct('ok', {ok}, 'v', named_struct('kind', {kind}, 's', _s_{name}[i], 'e', _s_{name}[i] + char_length(x), 'pattern', {pattern})))"
    return f"case when size(_m_{name}) > 0 then transform(filter({made}, z -> z.ok), z -> z.v) else cast(array() as {SPAN}) end"


def _pattern(name: str, kind: str, form: str, gazetteer: str) -> str:
    before = f"lower(right(_p_{name}[i], 24))"
    context = f"case when {before} rlike '{_words(AGAINST)}' then 'n' when {before} rlike '{_words(FOR)}' then 'y' else '-' end"
    size = "case when char_length(x) < 10 then 'a' when char_length(x) < 16 then 'b' when char_length(x) < 24 then 'c' else 'd' end"
    return f"concat_ws('/', {kind}, {form}, {gazetteer}, {context}, {size})"


def find(df: DataFrame) -> DataFrame:
    """Adds _base (spans that stay) and _loose (candidates) to rows with a column _text."""
    own = df.columns
    digits = "regexp_replace(x, '[^0-9]', '')"
    df = df.withColumn("_plain", F.expr(f"case when contains(_text, '{_MARK}') then translate(_text, '{_MARK}', '{_OTHER}') else _text end"))
    df = df.withColumn("_mail", F.expr(f"case when contains(_text, '@') then regexp_replace(_plain, {_sql('(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])')}, '{_MARK}') else '' end"))
    df = df.withColumn("_nums", F.expr(f"regexp_replace(_plain, {_sql('(?<=[0-9])[ -](?=[0-9])')}, '{_MARK}')"))
    df = _matches(df, "_mail", _EMAIL, "email", "contains(_text, '@')")
    df = _matches(df, "_plain", _IP, "ip", "contains(_text, '.')")
    df = _matches(df, "_nums", _CARD, "card", "true")
    df = _matches(df, "_plain", _PHONE, "phone", "contains(_text, '+')")
    loose = "|".join(f"(?:{p})" for p in (_ADDRESS, _ACCOUNT, _IDENTITY, _NUMBER))
    df = _matches(df, "_plain", loose, "loose", "true")

    top = f"case when substring_index(substring_index(x, '{_MARK}', -1), '.', -1) in ({', '.join(f"'{d}'" for d in DOMAINS.split())}) then 'y' else 'n' end"
    ip_ok = "forall(split(x, '[.]'), y -> length(trim(leading '0' from y)) <= 3 and cast(concat('0', trim(leading '0' from y)) as int) <= 255)"
    luhn = f"aggregate(sequence(1, length({digits})), 0, (a, j) -> a + (case when j % 2 = 1 then cast(substring({digits}, -j, 1) as int) else case when cast(substring({digits}, -j, 1) as int) > 4 then 2 * cast(substring({digits}, -j, 1) as int) - 9 else 2 * cast(substring({digits}, -j, 1) as int) end end)) % 10 = 0"
    card_ok = f"case when char_length(x) < 16 or length({digits}) not between 16 and 19 then false else {luhn} end"
    phone_ok = f"length({digits}) between 8 and 15"
    spans = {
        "email": _spans("email", "'email'", "true", _pattern("email", "'email'", "'y'", top)),
        "ip": _spans("ip", "'ip'", ip_ok, _pattern("ip", "'ip'", "'y'", "case when x rlike '^(0|127|255)[.]' then 'n' else 'y' end")),
        "card": _spans("card", "'card'", card_ok, _pattern("card", "'card'", "'y'", "case when x rlike '^[3-6]' then 'y' else 'n' end")),
        "phone": _spans("phone", "'phone'", phone_ok, _pattern("phone", "'phone'", "'y'", "case when x rlike '^[+](1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' then 'y' else '-' end")),
    }
    kind = f"case when x rlike {_sql('[(\\[]at[)\\]]')} then 'address' when x rlike '^[A-Z]' then 'account' when x rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'identity' else 'number' end"
    form = f"case when x rlike '^[A-Za-z]' then 'y' when length({digits}) between 7 and 13 then 'y' else 'n' end"
    known = f"case when x rlike {_sql('[(\\[]at[)\\]]')} then case when regexp_extract(x, '([A-Za-z]+)$', 1) in ({', '.join(f"'{d}'" for d in DOMAINS.split())}) then 'y' else 'n' end when x rlike '^[A-Z]' then case when substring(x, 1, 2) in ({', '.join(f"'{c}'" for c in COUNTRIES.split())}) then 'y' else 'n' end when x rlike '^[(]?0[1-9]' then 'y' when x rlike '^(19|20)[0-9]{{2}}[-./]' then 'n' else '-' end"
    df = df.withColumn("_base", F.expr(f"concat({', '.join(spans[k] for k in BASE)})"))
    df = df.withColumn("_all_loose", F.expr(_spans("loose", kind, "true", _pattern("loose", kind, form, known))))
    df = df.withColumn("_loose", F.expr("case when size(_all_loose) = 0 then _all_loose else filter(_all_loose, a -> not exists(_base, b -> b.s < a.e and a.s < b.e)) end"))
    return df.select(*own, "_base", "_loose")


def estimate(counts: dict[str, int]) -> dict[str, float]:
    """How likely each pattern (kind/format/gazetteer/context/size) is personal data: Dawid-Skene over votes, then a
    logistic classifier on its posteriors. counts has one entry a pattern, so this is a small fixed amount of work."""
    rows = [(p.split("/"), n) for p, n in sorted(counts.items())]
    kinds = sorted({p[0] for p, _ in rows})
    prior = dict.fromkeys(kinds, 0.5)
    # P(vote | truth) for the three labelers: better than chance to begin with
    table = [{True: {"y": 0.7, "-": 0.2, "n": 0.1}, False: {"y": 0.2, "-": 0.4, "n": 0.4}} for _ in range(3)]
    post: list[float] = []
    for _ in range(50):
        post = []
        for p, _n in rows:
            yes, no = prior[p[0]], 1 - prior[p[0]]
            for t, v in zip(table, p[1:4], strict=True):
                yes, no = yes * t[True][v], no * t[False][v]
            post.append(yes / (yes + no))
        for k in kinds:
            part = [(q, n) for (p, n), q in zip(rows, post, strict=True) if p[0] == k]
            prior[k] = min(0.95, max(0.05, (1 + sum(q * n for q, n in part)) / (2 + sum(n for _, n in part))))
        for j, t in enumerate(table):
            for truth in (True, False):
                mass = {v: 1.0 + sum((q if truth else 1 - q) * n for (p, n), q in zip(rows, post, strict=True) if p[1 + j] == v) for v in "y-n"}
                t[truth] = {v: m / sum(mass.values()) for v, m in mass.items()}
    weight: dict[str, float] = {}
    total = sum(n for _, n in rows)
    parts = [[f"{i}{v}" for i, v in enumerate(p)] + ["bias"] for p, _ in rows]
    sure = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(f, 0.0) for f in x)))))
    for _ in range(300):
        slope: dict[str, float] = {}
        for x, (_, n), q in zip(parts, rows, post, strict=True):
            off = n / total * (q - sure(x))
            for f in x:
                slope[f] = slope.get(f, 0.0) + off
        for f, g in slope.items():
            weight[f] = 0.999 * weight.get(f, 0.0) + 2.0 * g
    return {"/".join(p): sure(x) for (p, _), x in zip(rows, parts, strict=True)}


def accepted(found: DataFrame) -> list[str]:
    """The patterns of loose candidates that the classifier takes."""
    counts = found.select(F.explode(F.concat("_base", "_loose")).alias("x")).groupBy("x.pattern").count()
    likely = estimate({r["pattern"]: r["count"] for r in counts.collect()})  # one row a pattern
    return sorted(p for p, q in likely.items() if p.split("/")[0] in LOOSE and q > ACCEPT)


def _taken(patterns: list[str]) -> str:
    quoted = ", ".join(f"'{p}'" for p in patterns)
    return f"filter(_loose, x -> x.pattern in ({quoted}))" if patterns else f"cast(array() as {SPAN})"


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = find(texts(docs).select("doc_id", F.col("text").alias("_text"))).drop("_text")
    found = Scratch(spark, "personal").write(rows, "found")
    order = " + ".join(f"{i} * cast(x.kind = '{k}' as int)" for i, k in enumerate(LOOSE))
    found = found.withColumn("_more", F.expr(f"transform(array_sort(transform({_taken(accepted(found))}, x -> named_struct('o', {order}, 's', x.s, 'e', x.e, 'v', x))), z -> z.v)"))
    number = [F.expr(f"cast(size(filter(_base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *number, F.sha2(F.expr(_joined("_base")), 256).alias("base_sha256"), F.expr(_joined("concat(_base, _more)")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with <kind> in place of every span, with all their columns; n_chars follows the text where it is a column."""
    rows = find(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs["text"], F.lit("")).alias("_text"))).drop("_text")
    rows = Scratch(spark, "personal").write(rows, "found")  # the patterns go over each text once
    patterns = accepted(rows)
    rows = rows.withColumn("_text", F.coalesce("_row.text", F.lit("")))
    rows = rows.withColumn("_cut", F.expr(f"array_sort(transform(concat(_base, {_taken(patterns)}), x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"))
    joined = "aggregate(_cut, cast(array() as array<struct<s: bigint, e: bigint, kind: string>>), (a, x) -> case when size(a) > 0 and element_at(a, -1).e > x.s then concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e), 'kind', element_at(a, -1).kind))) else concat(a, array(x)) end)"
    rows = rows.withColumn("_cut", F.expr(f"case when size(_cut) > 1 then {joined} else _cut end"))
    parts = "transform(_cut, (x, i) -> concat(substring(_text, cast(if(i > 0, _cut[i - 1].e, 0) as int) + 1, cast(x.s - if(i > 0, _cut[i - 1].e, 0) as int)), '<', x.kind, '>'))"
    text = f"case when size(_cut) = 0 then _row.text else concat(array_join({parts}, ''), substring(_text, cast(element_at(_cut, -1).e as int) + 1)) end"
    rows = rows.withColumn("_new", F.expr(text))
    made = [F.col("_new").alias("text") if c == "text" else F.when(F.col("_row.text").isNull(), F.col("_row.n_chars")).otherwise(F.char_length("_new")).cast(t).alias(c) if c == "n_chars" else F.col("_row").getField(c).alias(c) for c, t in docs.dtypes]
    return rows.select(*made)
