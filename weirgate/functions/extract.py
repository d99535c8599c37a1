"""Typed values out of JSON documents: NULL when the JSON kind is not the asked one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import spark_type

PARSED = "__parsed_doc"

# The two text forms of an instant that are read; anything else is NULL.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
LOCAL_INSTANT = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"

# Milliseconds that are a timestamp: those whose microseconds fit 64 bits.
MOST_MILLIS = (2**63 - 1) // 1000

INT_BITS = {"tinyint": 8, "smallint": 16, "int": 32}


def json_path(path: str | Sequence[str]) -> str:
    """``user.name`` -> ``$['user']['name']``; each dot is one object step, as is each item of a list."""
    steps = path.split(".") if isinstance(path, str) else path
    return "$" + "".join(f'["{step}"]' if "'" in step else f"['{step}']" for step in steps)


def parsed(df: DataFrame, doc: str) -> DataFrame:
    """Parse the JSON text column once per row; every extractor below reads the parsed column."""
    return df.withColumn(PARSED, F.parse_json(F.col(doc)))


def value_at(variant: Column, path: str | Sequence[str]) -> Column:
    """The value at a dotted path, NULL if any step is missing."""
    return F.variant_get(variant, json_path(path), "variant")


def json_kind(variant: Column) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, STRING, VOID, ARRAY<..> or OBJECT<..>."""
    return F.schema_of_variant(variant)


def as_bool(variant: Column, kind: Column | None = None) -> Column:
    kind = json_kind(variant) if kind is None else kind
    return F.when(kind == "BOOLEAN", F.try_variant_get(variant, "$", "boolean"))


def as_int(variant: Column, kind: Column | None = None) -> Column:
    """Whole JSON numbers that fit 64 bits; ``"12"`` and ``12.0`` are NULL."""
    kind = json_kind(variant) if kind is None else kind
    return F.when(kind == "BIGINT", F.try_variant_get(variant, "$", "bigint"))


def as_float(variant: Column, kind: Column | None = None, whole: bool = True) -> Column:
    """Any JSON number, or only those written as a fraction if ``whole`` is off."""
    kind = json_kind(variant) if kind is None else kind
    numeric = kind.isin("DOUBLE", "FLOAT", *(["BIGINT"] if whole else [])) | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(variant, "$", "double"))


def wrap_int(value: Column, target: str) -> Column:
    """Keep the low bits of a 64-bit integer: 300 as tinyint is 44. No error on overflow."""
    bits = INT_BITS[target]
    return F.shiftright(F.shiftleft(value.cast("bigint"), 64 - bits), 64 - bits).cast(target)


def text_to_instant(text: Column) -> Column:
    """RFC 3339, or date and time without a zone read as UTC; other text is NULL. Millisecond precision."""
    zoned = F.when(text.rlike(RFC3339), F.upper(text))
    local = F.when(text.rlike(LOCAL_INSTANT), F.concat(text, F.lit("Z")))
    return F.date_trunc("MILLISECOND", F.coalesce(zoned, local).try_cast("timestamp"))


def as_instant(variant: Column, kind: Column | None = None) -> Column:
    """Whole numbers are epoch milliseconds, strings are parsed, everything else is NULL.

    So is a number whose microseconds don't fit 64 bits.
    """
    kind = json_kind(variant) if kind is None else kind
    text = F.try_variant_get(variant, "$", "string")
    whole = F.try_variant_get(variant, "$", "bigint")
    return F.when(kind == "STRING", text_to_instant(text)).when(
        (kind == "BIGINT") & whole.between(-MOST_MILLIS, MOST_MILLIS), F.timestamp_millis(whole)
    )


def as_text(
    variant: Column,
    doc: Column,
    path: str | Sequence[str],
    kind: Column | None = None,
    null_text: str | None = "null",
) -> Column:
    """Strings as they are, any other kind as JSON text; JSON ``null`` is the text ``null_text``.

    Numbers and containers are copied from the document, because a parsed 12.0 prints as 12. A path with
    an apostrophe can't be written for the copy, so there the parsed value is printed.
    """
    kind = json_kind(variant) if kind is None else kind
    text = (
        F.when(kind.isin("STRING", "BIGINT", "BOOLEAN"), F.try_variant_get(variant, "$", "string"))
        .when(kind == "VOID", F.lit(null_text))
        .otherwise(F.to_json(variant) if "'" in "".join(path) else F.get_json_object(doc, json_path(path)))
    )
    return F.when(variant.isNotNull(), text)


def typed_value(
    variant: Column,
    doc: Column,
    path: str | Sequence[str],
    target: str,
    kind: Column | None = None,
    strict: bool = False,
) -> Column:
    """A value found at ``path``, read as the Spark type ``target``.

    ``strict`` values are of their column's kind exactly: a whole number is no float, a null no text.
    """
    if target == "boolean":
        return as_bool(variant, kind)
    if target in INT_BITS:
        return wrap_int(as_int(variant, kind), target)
    if target == "bigint":
        return as_int(variant, kind)
    if target in ("float", "double"):
        return as_float(variant, kind, not strict).cast(target)
    if target == "timestamp":
        return as_instant(variant, kind)
    return as_text(variant, doc, path, kind, None if strict else "null")


def extract_fields(
    df: DataFrame,
    doc: str,
    fields: Iterable[tuple[str | Sequence[str], str]],
    keep: Iterable[str] = (),
) -> DataFrame:
    """One column per ``(path, document type name)``, named by its dotted path, next to ``keep``."""
    targets = [(path, spark_type("elasticsearch", name)) for path, name in fields]
    return extract_typed(df, doc, targets, keep)


def extract_typed(
    df: DataFrame,
    doc: str,
    targets: Sequence[tuple[str | Sequence[str], str]],
    keep: Iterable[str] = (),
    strict: bool = False,
) -> DataFrame:
    """One column per ``(path, Spark type)``. The document, each value and each kind are worked out once."""
    kept = [F.col(f"`{c}`") for c in keep]
    values = [value_at(F.col(PARSED), path).alias(f"__value{i}") for i, (path, _) in enumerate(targets)]
    found = parsed(df, doc).select(*kept, F.col(doc).alias("__doc"), *values)
    kinds = {f"__kind{i}": json_kind(F.col(f"__value{i}")) for i in range(len(targets))}
    found = found.withColumns(kinds) if kinds else found
    columns = [
        typed_value(F.col(f"__value{i}"), F.col("__doc"), path, target, F.col(f"__kind{i}"), strict).alias(
            path if isinstance(path, str) else ".".join(path)
        )
        for i, (path, target) in enumerate(targets)
    ]
    return found.select(*kept, *columns)
