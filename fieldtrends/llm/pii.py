"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame operations only. Positions come from the gaps between matches: ``split`` and ``regexp_extract_all``
with the same expression give gaps and matches in turn, and a running sum of their lengths gives the places.
Every expression reads a text in linear time and without recursion: quantifiers are possessive where nothing
can be given back, and runs are entered at their first character or where the last match ended (``\\G``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrends.llm.common import quoted, text_or_empty, whole_row

#: Points a span needs. Base kinds that pass their validator have them without context.
NEEDED = 1.0
CONTEXT_POINTS = 0.5
CONTEXT_CHARS = 40


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn: from the right, every second digit is doubled and its digits added."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (
        F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number passes mod 97: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def octets(match: Column) -> Column:
    """Parts of at most 255, whatever their leading zeros."""
    return F.forall(F.split(match, r"\."), lambda x: F.ltrim(x, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


#: Characters of an account number per country, as listed by its registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_run() -> str:
    """Runs of exactly the length of their country, so following words stay out; a code that is not listed takes what follows, up to a listed one."""
    listed = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes.split())
    runs = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items()]
    other = f"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{listed})[0-9]{{2}}) ?[A-Z0-9]){{11,30}}+"
    return f"(?<![A-Za-z0-9])(?:{'|'.join([*runs, other])})(?![A-Za-z0-9])"


def many_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits_of(match)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without a match of this cheap expression cannot hold the kind
    valid: Callable[[Column], Column]
    score: float
    context: str  # words that add points when they stand nearby


KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 1.0, r"mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", octets, 1.0, r"\bip\b|host|server|address"),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]", lambda m: many_digits(12, 19)(m) & luhn(digits_of(m)), 1.0, r"card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", many_digits(9, 15), 1.0, r"phone|tel|call|mobile|fax"),
    Kind("iban", iban_run(), "[A-Z]{2}[0-9]{2}", mod97, 1.0, r"iban|account|bank"),
    # a number that looks like a national id counts only where a word nearby says so
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.5, r"ssn|social|security|national|identity"),
]


def _found(kind: Kind) -> Column:
    """Valid spans of one kind: kind, rank, start, end (code points, end exclusive), score."""
    text = F.col("text")
    lengths = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
                         lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    empty = F.array().cast("array<struct<start:int,m:string>>")
    placed = F.aggregate(
        F.filter(lengths, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["m"].alias("m")))).alias("out")),
        lambda a: a["out"],
    )
    rank = [k.name for k in KINDS].index(kind.name)

    def near(s: Column) -> Column:
        begin, end = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"] + F.length(s["m"])
        around = F.concat(F.substr(text, begin + 1, s["start"] - begin), F.lit("\n"), F.substr(text, end + 1, F.lit(CONTEXT_CHARS)))
        return F.lower(around).rlike(kind.context)

    spans = F.transform(F.filter(placed, lambda s: kind.valid(s["m"])), lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (s["start"] + F.length(s["m"])).alias("end"),
        (F.lit(kind.score) + F.when(near(s), CONTEXT_POINTS).otherwise(0.0)).alias("score")))
    sure = F.filter(spans, lambda s: s["score"] >= NEEDED)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    return F.when(text.rlike(kind.hint), sure).otherwise(none)


def _spans_of_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text, spans."""
    names = [f"f_{k.name}" for k in KINDS]
    rows = docs.select(whole_row(docs), F.col("text").alias("given"), text_or_empty().alias("text"))
    rows = rows.select("row", "given", "text", *[_found(k).alias(n) for k, n in zip(KINDS, names)])
    return rows.select("row", F.col("given").alias("text"), F.array_sort(F.flatten(F.array(*names))).alias("spans"))


def spans(docs: DataFrame) -> DataFrame:
    """Adds ``spans`` to the rows: array of (start, rank, kind, end, score) by start, then kind as listed in KINDS.

    Matches of a kind are leftmost and do not overlap; kinds may overlap each other. A match that fails its
    validator is dropped and not tried again in part. Null and empty texts have no spans; other columns stay as
    they are (a column called ``spans`` is replaced), and an empty table stays empty. Texts are read whole.
    """
    kept = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c != "spans"]
    return _spans_of_rows(docs).select(*kept, "spans")


def described(kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    some = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame) -> DataFrame:
    """Replaces every span of ``text`` by its kind in brackets; overlapping spans become one, named by the first.

    Texts without spans, null ones too, stay as they are, and so do all other columns, whatever their names. Repeated rows
    stay repeated, and an empty table stays empty.
    """
    found = _spans_of_rows(docs)
    first = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def merged(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))))
        new = F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.when(F.size(a) == 0, new).when(s["start"] < last["end"], grown).otherwise(new)

    rows = found.withColumn("cut", F.when(F.size("spans") > 0, F.aggregate("spans", first, merged)))
    pieces = F.transform("cut", lambda s, i: F.concat(
        F.substr("text", F.when(i == 0, 1).otherwise(F.element_at("cut", F.greatest(i, F.lit(1)))["end"] + 1),
                 s["start"] - F.when(i == 0, 0).otherwise(F.element_at("cut", F.greatest(i, F.lit(1)))["end"])),
        F.lit("["), F.upper(s["kind"]), F.lit("]")))
    whole = F.concat(F.array_join(pieces, ""), F.substr(F.col("text"), F.element_at("cut", -1)["end"] + 1))
    return rows.select(F.col("row").withField("text", F.when(F.col("cut").isNotNull(), whole).otherwise(F.col("text"))).alias("row")).select("row.*")
