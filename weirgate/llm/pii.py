"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Everything is DataFrame functions. A pattern is run once to split the text; only where it splits, the
matches are read and their places follow from the lengths of the parts. The patterns have possessive
quantifiers and look behind a run's first character, which gives the same matches as plain ones in
time that is linear in the text, and without recursion.

Places count code points from 0; an end is exclusive. Defined cases: a null text is an empty text and
has no spans; spans of different kinds, and account numbers, may overlap (``redact`` hides their union). Rows keep all their
columns, whatever their names, unless a name begins with ``__pii``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points before and after a span in which context words count.
CONTEXT = 40
# What a context word adds to a score, and the score a span needs if its kind isn't certain.
BONUS, NEEDED = 0.35, 0.5
# Parts whose lengths are summed up at once, so that a text with very many matches stays affordable.
BLOCK = 512


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test for texts that may match; ``certain`` spans need no score."""

    name: str
    pattern: str
    hint: str
    context: str
    score: float
    certain: bool


# The countries of each length of an account number, by the IBAN registry and the countries that use the form without it.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _iban() -> str:
    """A number is as long as its country says; of another country, the whole run of signs."""
    listed = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
    others = f"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+"
    return f"(?:{listed}|{others})(?![A-Za-z0-9])"


IBAN = _iban()
# Signs that the longest of them can have, blanks included, and one more.
IBAN_SPAN = 4 + 2 * 30 + 1

# The kinds in the order of the result. The first four are certain once their check holds.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        r"\b(?:e-?mail|mail|contact|write)\b",
        0.9,
        True,
    ),
    Kind(
        "ip",
        r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
        ".",
        r"\b(?:ip|host|server|address|login)\b",
        0.6,
        True,
    ),
    Kind(
        "card",
        r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
        "",
        r"\b(?:card|visa|mastercard|credit|debit|payment)\b",
        0.6,
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "+",
        r"\b(?:phone|tel|call|mobile|fax)\b",
        0.6,
        True,
    ),
    Kind(
        "iban",
        # Only the first four signs are taken, so that a number behind what looks like one is found too.
        rf"\b(?={IBAN})[A-Z]{{2}}[0-9]{{2}}",
        "",
        r"\b(?:iban|account|bank|transfer)\b",
        0.6,
        False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-",
        r"\b(?:ssn|social|security)\b",
        0.3,
        False,
    ),
)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _starts(steps: Column, blocks: Column) -> Column:
    """The sum of the steps up to and with each one."""
    return F.transform(
        steps,
        lambda _, i: F.element_at(blocks, F.floor(i / BLOCK).cast("int") + 1)
        + _total(F.slice(steps, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK + 1).cast("int"))),
    )


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97(iban: Column) -> Column:
    """Whether an account number's remainder is 1, with its first four signs at the end and letters as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    signs = F.split(turned, "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(signs, lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97).cast("int"),
    )
    return rest == 1


def _holds(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        small = lambda part: F.coalesce(part.try_cast("decimal(38,0)") <= 255, F.lit(False))
        return F.forall(F.split(hit, "\\."), small)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(hit, F.lit(" "), F.lit("")))
    return F.lit(True)


def _spans_of(df: DataFrame, kind: Kind, text: Column) -> DataFrame:
    """Adds ``__pii_<kind>``: the confirmed spans of one kind, by start."""
    parts, hits, steps, blocks, found = (f"__pii_{x}_{kind.name}" for x in ("parts", "hits", "steps", "blocks", "found"))
    maybe = text.contains(kind.hint) if kind.hint else text.rlike(_HINTS[kind.name])
    # null: nothing to look at
    df = df.withColumn(parts, F.when(maybe, F.split(text, kind.pattern, -1)))
    several = F.size(parts) > 1
    df = df.withColumn(hits, F.when(several, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))))
    df = df.withColumn(
        steps,
        F.transform(
            hits,
            lambda _, i: (F.length(F.get(parts, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0)).cast("long"),
        ),
    ).drop(parts)
    ends = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(steps, b * BLOCK + 1, BLOCK)))
    df = df.withColumn(blocks, F.when(F.col(hits).isNotNull(), ends))
    df = df.withColumn(
        blocks, F.transform(F.col(blocks), lambda _, b: _total(F.slice(F.col(blocks), F.lit(1), b)))
    )
    df = df.withColumn(found, F.when(F.col(hits).isNotNull(), _starts(F.col(steps), F.col(blocks))))

    def span(start: Column, i: Column) -> Column:
        hit = F.get(F.col(hits), i)
        if kind.name == "iban":
            hit = F.regexp_extract(F.substring(text, (start + 1).cast("int"), F.lit(IBAN_SPAN)), f"^{IBAN}", 0)
        end = start + F.length(hit)
        left = F.greatest(start - CONTEXT, F.lit(0))
        near = F.lower(
            F.concat(
                F.substring(text, (left + 1).cast("int"), (start - left).cast("int")),
                F.lit(" . "),
                F.substring(text, (end + 1).cast("int"), F.lit(CONTEXT)),
            )
        )
        score = F.round(F.lit(kind.score) + F.when(near.rlike(kind.context), BONUS).otherwise(0.0), 2)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            F.least(score, F.lit(1.0)).alias("score"),
            _holds(kind.name, hit).alias("holds"),
        )

    spans = F.filter(
        F.transform(F.col(found), span),
        lambda s: s["holds"] & (F.lit(kind.certain) | (s["score"] >= NEEDED)),
    )
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,holds:boolean>>")
    df = df.withColumn(f"__pii_{kind.name}", F.coalesce(spans, empty))
    return df.drop(hits, steps, blocks, found)


# What a text must have for the two kinds without a single sign that all their matches have.
_HINTS = {"card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``pii``: the spans (kind, start, end, score) by kind, then start."""
    df = df.withColumn("__pii_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col("__pii_text")
    for kind in KINDS:
        df = _spans_of(df, kind, text)
    own = [f"__pii_{k.name}" for k in KINDS]
    return df.withColumn("pii", F.transform(F.concat(*own), lambda s: s.dropFields("holds"))).drop(*own, "__pii_text")


def redact(df: DataFrame, text_col: str = "text", spans: str = "pii") -> DataFrame:
    """The rows with each span of the text hidden: ``[EMAIL]`` for an email, and so on.

    Where spans overlap, the first one's name stands for all of them. A text without spans stays as it is.
    """
    text = F.col(text_col)
    df = df.withColumn("__pii_by_start", F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    by = F.col("__pii_by_start")
    df = df.withColumn(
        "__pii_from", F.transform(by, lambda _, i: F.coalesce(F.array_max(F.transform(F.slice(by, F.lit(1), i), lambda s: s["end"])), F.lit(0)))
    )
    after = F.col("__pii_from")

    def piece(s: Column, i: Column) -> Column:
        clear = F.substring(text, (F.get(after, i) + 1).cast("int"), (s["start"] - F.get(after, i)).cast("int"))
        hidden = F.concat(clear, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= F.get(after, i), hidden).otherwise("")

    end = F.array_max(F.transform(by, lambda s: s["end"]))
    rest = F.substring(text, (end + 1).cast("int"), F.length(text))
    masked = F.when(F.size(by) > 0, F.concat(F.array_join(F.transform(by, piece), ""), rest)).otherwise(text)
    return df.withColumn(text_col, masked).drop("__pii_by_start", "__pii_from")


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
