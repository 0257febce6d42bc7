"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Five kinds. Base spans are what a pattern proposes and its check confirms: e-mail addresses; dotted
quads whose parts are at most 255; card numbers of 13 to 19 digits that pass Luhn; international
phone numbers of 9 to 15 digits. Added ones need more: account numbers (iban) must pass mod-97,
and national phone numbers need a word for telephone close by. Every span has a score: its kind's
own (a checksum counts much), plus or minus what words within `near` code points speak for or
against it. Base spans stay whatever their score; added ones need `least`.

All in SQL functions over one row: split() gives the text between a pattern's matches and
regexp_extract_all() the matches, so a running sum of lengths gives places in code points. Nothing
is shuffled, and a row's work is linear in its text: patterns only start where a run begins, never
go back into what they have read, and sums are made block by block. Where a card's pattern would match a
longer run of digits, it proposes nothing: a run of another length fails its check whole.

Defined results: a null text is empty and has no spans; spans of one kind do not overlap, those of two kinds
can; repeated rows and null ids are rows like others; a text must fit a task. No rows give no rows. Columns of
the input named like an output give way; any other names are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = ("spans",)
BLOCK = 64
SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean>"


def luhn(m: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))


def mod97(m: Column) -> Column:
    """ISO 13616: the first four characters go to the end, letters count from 10, and the number leaves 1."""
    text = F.upper(F.regexp_replace(m, "[^A-Za-z0-9]", ""))
    moved = F.split(F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4)), "")
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + digit(c)) % 97)
    return F.length(text).between(15, 34) & (rest == 1)


def octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")


def digits(low: int, high: int):
    return lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(low, high)


@dataclass(frozen=True)
class Kind:
    """A pattern, the check of what it proposes, its score and the words that speak for and against it."""

    name: str
    pattern: str
    valid: object
    score: float
    base: bool
    hint: str  # a cheap test of the whole text
    good: str
    bad: str


PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = (
    # a local part starts where its run of characters does, or where the last match ended
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.9, True, "@", r"\b(?:e-?mail|contact|write|reach|kontakt|correo|courriel)", r"\b(?:noreply|no-reply|example only)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.7, True, ".", r"\b(?:ip|host|server|address|login|client|proxy)\b", r"\b(?:version|release|build|section|chapter|v)\s*$"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", luhn, 0.9, True, "", r"\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b", r"\b(?:order|invoice|isbn|serial|tracking|ref)\b"),
    Kind("phone", PHONE, digits(9, 15), 0.8, True, "+", r"\b(?:tel|phone|call|mobile|fax|cell|telefon|teléfono|téléphone)", r"\b(?:score|version|ratio)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+|[A-Z0-9]{11,30}+)(?![A-Za-z0-9])", mod97, 0.9, False, "", r"\b(?:iban|account|bank|konto|cuenta|compte)\b", r"\b(?:part|serial|licen[cs]e)\b"),
    # what a base pattern takes first is not there for this one
    Kind("phone", PHONE + r"|(?<![0-9+.(-])(?<![0-9]\x20)(?:\([0-9]{2,4}\)\x20?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", lambda m: digits(9, 15)(m) & ~m.startswith("+"), 0.4, False, "", r"\b(?:tel|phone|call|mobile|fax|cell|telefon|teléfono|téléphone)", r"\b(?:score|version|ratio|order|isbn)\b"),
)
ORDER = ("email", "ip", "card", "phone", "iban")
CONTEXT = 0.3


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def sums_before(values: Column, depth: int = 2) -> Column:
    """Of each place of an array of numbers, the sum of all before it: blocks of BLOCK, their sums in the same way."""
    add = lambda v, first, many: F.aggregate(F.slice(v, first, many), F.lit(0), lambda acc, x: acc + x)
    if not depth:
        return F.transform(values, lambda _, i: add(values, F.lit(1), i))
    block = lambda i: F.call_function("div", i, F.lit(BLOCK)).cast("int")
    heads = F.when(F.size(values) > 0, F.sequence(F.lit(0), block(F.size(values) - 1))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(heads, lambda b: add(values, b * BLOCK + 1, F.lit(BLOCK)))
    return bound(sums, lambda s: bound(sums_before(s, depth - 1), lambda tops: F.transform(values, lambda _, i: F.get(tops, block(i)) + add(values, block(i) * BLOCK + 1, i % BLOCK))))


def _placed(text: Column, pattern: str) -> Column:
    """The matches in order: start, end, match, and the text before and after it, up to the next match."""
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")

    def item(gaps, starts):
        def one(m, i):
            begin = F.get(starts, i) + F.length(F.get(gaps, i))
            return F.struct(begin.alias("start"), (begin + F.length(m)).alias("end"), m.alias("m"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))

        return one

    def places(found, gaps):
        steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
        return bound(steps, lambda v: bound(sums_before(v), lambda starts: F.transform(found, item(gaps, starts))))

    # one gap more than there are matches
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), lambda gaps: places(found, gaps))).otherwise(none))


def _scored(text: Column, kind: Kind, near: int, least: float) -> Column:
    found = _placed(text, kind.pattern)
    if kind.valid:
        found = F.filter(found, lambda x: kind.valid(x.m))

    def span(x):
        before, after = F.lower(F.right(x.before, F.lit(near))), F.lower(F.left(x.after, F.lit(near)))
        says = lambda words: F.when(before.rlike(words) | after.rlike(words), CONTEXT).otherwise(0.0)
        score = F.lit(kind.score) + says(kind.good) - says(kind.bad)
        return F.struct(F.lit(kind.name).alias("kind"), x.start.alias("start"), x.end.alias("end"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3).alias("score"), F.lit(kind.base).alias("base"))

    out = F.transform(found, span).cast(f"array<{SPAN}>")
    out = out if kind.base else F.filter(out, lambda s: s.score >= least)
    return F.when(F.instr(text, kind.hint) > 0, out).otherwise(F.array().cast(f"array<{SPAN}>")) if kind.hint else out


def personal_data(docs: DataFrame, text_col: str = "text", near: int = 40, least: float = 0.6, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs plus spans: kind, start, end (code points, end exclusive), score and base, by kind and start."""
    own = [c for c in docs.columns if c not in OUT]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    groups = {name: [_scored(F.col("text"), k, near, least) for k in kinds if k.name == name] for name in dict.fromkeys(k.name for k in kinds)}
    spans = []
    for found in groups.values():
        if len(found) == 1:
            spans.append(found[0])
            continue
        spans.append(F.array_sort(F.concat(*found), lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(a.end - b.end)))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in own), F.concat(*spans).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    out = personal_data(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)
    # bound once: what it holds is asked for six times
    held = out.select("doc_id", "spans", base.alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return held.select("doc_id", *(count(k) for k in ORDER[:4]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
