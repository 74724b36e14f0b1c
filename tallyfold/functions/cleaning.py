"""Cleaning, parsing and harmonising of columns. Blank and bad values become null, never zero, unless said."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean "no value".
NO_VALUE = ("", "None", "nan", "No Aplica")


def tolerant_int(c: Column, default: int | None = None) -> Column:
    """Whole part of a number in text; ``default`` for blank or bad text."""
    value = c.try_cast("double").try_cast("long")
    return value if default is None else F.coalesce(value, F.lit(default))


def bounded_int(c: Column, bits: int) -> Column:
    """A plain integer that fits into ``bits`` bits, else null."""
    value = F.when(c.rlike(r"^-?[0-9]+$"), c.try_cast("decimal(38,0)"))
    return F.when(value.between(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1), value).cast("long")


def int_exception(c: Column, name: str, bits: int) -> Column:
    """The tag of a value that ``bounded_int`` refuses, null for blank and good values."""
    blank = c.isNull() | (F.trim(c) == "")
    return F.when(~blank & bounded_int(c, bits).isNull(), F.lit(f"bad_{name}"))


def first_date(c: Column, formats: list[str]) -> Column:
    """By the first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats))


def clean_text(c: Column) -> Column:
    """Trimmed, spaces collapsed, without trailing note asterisks; texts that mean no value become null."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r"\s*\*+$", "")
    return F.when(text.isin(*NO_VALUE), None).otherwise(text)


def comma_number(c: Column) -> Column:
    """A number with a decimal comma or point; not finite gives null."""
    value = F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def pad_code(c: Column, width: int) -> Column:
    """Zero-padded code, only where the integer stays the same; longer codes give null."""
    text = F.lpad(c, width, "0")
    return F.when((F.length(c) <= width) & (text.try_cast("long") == c.try_cast("long")), text)


def same_code(c: Column, code: str, width: int = 2) -> Column:
    """Whether ``13``, ``013`` and ``13.0`` alike are the code."""
    whole = F.regexp_replace(F.split(F.trim(c), r"\.")[0], "^0+(?=.)", "")
    return F.lpad(whole, width, "0") == code


def slug(c: Column, prefix: str = "") -> Column:
    """Upper-case id without accents and prefix, words joined by underscores."""
    text = F.regexp_replace(F.trim(c), f"^{re.escape(prefix)}", "") if prefix else F.trim(c)
    text = F.translate(F.upper(text), "ÁÉÍÓÚÜÑ", "AEIOUUN")
    return F.regexp_replace(F.regexp_replace(text, "[^A-Z0-9]+", "_"), "^_|_$", "")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is above 0."""
    return F.when(denominator > 0, numerator / denominator)


def value_or_symbol(c: Column) -> tuple[Column, Column]:
    """(number, text): exactly one is set where the cell is not blank."""
    value = F.trim(c).try_cast("double")
    return value, F.when(value.isNull() & (F.trim(c) != ""), F.trim(c))


def bed_cell(c: Column) -> tuple[Column, Column]:
    """(value, is_error): blank or asterisks are null, whole non-negative numbers stay, the rest is an error."""
    text = F.trim(F.coalesce(c, F.lit("")))
    good = text.rlike("^[0-9]+$")
    return F.when(good, text.try_cast("long")), ~good & ~text.rlike(r"^\**$")


def first_label(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule that fires."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, label in rules[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def tags(*named: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named)))


def age_band(unit: Column, quantity: Column) -> Column:
    """Band of an age given in years (1), months (2), days (3) or hours (4)."""
    years = F.when(unit == 1, quantity).when(unit.isin(2, 3, 4), 0)
    possible = (quantity >= 0) & F.when(unit == 1, quantity <= 120).when(unit == 2, quantity <= 11).when(unit == 3, quantity <= 30).when(unit == 4, quantity <= 23).otherwise(False)
    return first_label([(possible.isNull() | ~possible, "unknown"), (years < 15, "00-14"), (years < 30, "15-29"), (years < 45, "30-44"), (years < 65, "45-64")], "65+")


def snake_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores."""
    return df.toDF(*(re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", n).lower()).strip("_") for n in df.columns))


def alias_of(df: DataFrame, *names: str) -> Column:
    """The column under whichever of its names the table has."""
    there = [n for n in names if n in df.columns]
    if not there:
        raise ValueError(f"none of {names} is a column")
    return F.coalesce(*(F.col(n) for n in there))


def newest_column(columns: list[str], prefix: str) -> tuple[str, int]:
    """(name, year) of the newest ``prefix`` + year; marks after the year are ignored."""
    found = [(int(m[1]), c) for c in columns if (m := re.match(rf"{re.escape(prefix)}(\d{{4}})\D*$", c))]
    year, name = max(found)
    return name, year
