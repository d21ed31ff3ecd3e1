"""Amounts and units.

Whole values are handled by Column expressions.  Replacing numbers inside
running text needs a computed replacement, which ``regexp_replace`` lacks:
those functions are Arrow-batched Pandas UDFs around one ``re.sub`` each.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brinework.functions.text import _col

#: Factors of the unit words, in the order in which they are looked for.
UNITS = (("천원", 10**3), ("백만원", 10**6), ("억원", 10**8), ("조원", 10**12))
_FACTOR = dict(UNITS)
_HAS_UNIT = "(?:[억만천백십]|원|주|%|건|개|명|년|월|일)"


def unit_factor(unit: str | Column) -> Column:
    """The factor of the first unit word that the text contains, else 1."""
    unit = F.coalesce(_col(unit), F.lit(""))
    out = F.lit(1).cast("long")
    for word, factor in reversed(UNITS):
        out = F.when(unit.contains(word), F.lit(factor).cast("long")).otherwise(out)
    return out


def scaled(value: str | Column, unit: str | Column) -> Column:
    """A numeric value times its unit, as integer text; anything else unchanged."""
    value = _col(value)
    number = F.regexp_replace(value, "[, ]", "")
    return F.when(number.rlike(r"^-?\d+(\.\d+)?$"), (number.try_cast("double") * unit_factor(unit)).try_cast("decimal(38,0)").cast("string")).otherwise(value)


def whole_number(value: str | Column) -> Column:
    """The number in text with commas and blanks, or null."""
    return F.regexp_replace(_col(value).cast("string"), "[, ]", "").try_cast("decimal(38,0)")


def amount(value: str | Column) -> Column:
    """An amount in 억원, 만원 or 원, with one decimal where it isn't whole; text that is no number unchanged."""
    n = whole_number(value)

    def by(size: int, unit: str) -> Column:
        x = n.cast("double") / size
        return F.concat(F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 1)), F.lit(unit))

    return F.when(n.isNull(), _col(value).cast("string")).when(F.abs(n) >= 10**8, by(10**8, "억원")).when(F.abs(n) >= 10**4, by(10**4, "만원")).otherwise(F.concat(F.format_number(n.cast("double"), 0), F.lit("원")))


def currency(value: str | Column, factor: int = 1) -> Column:
    """Like :func:`amount`, after multiplying, with 만원 rounded down."""
    n = whole_number(value) * factor
    eok = n.cast("double") / 10**8
    return (
        F.when(n.isNull(), _col(value).cast("string"))
        .when(n >= 10**8, F.concat(F.when(eok == F.floor(eok), F.format_number(eok, 0)).otherwise(F.format_number(eok, 1)), F.lit("억원")))
        .when(n >= 10**4, F.concat(F.format_number(F.floor(n / 10**4).cast("double"), 0), F.lit("만원")))
        .otherwise(F.concat(F.format_number(n.cast("double"), 0), F.lit("원")))
    )


def with_unit(value: str | Column, unit: str) -> Column:
    """A whole number with commas and its unit; other text gets the unit as it is."""
    n = whole_number(value)
    return F.concat(F.coalesce(F.format_number(n.cast("double"), 0), _col(value).cast("string")), F.lit(unit))


def _amount(n: float, *, decimals_of_jo: bool = False) -> str:
    if decimals_of_jo and abs(n) >= 10**12:
        return f"{n / 10**12:.1f}조원"
    for size, unit in ((10**8, "억원"), (10**4, "만원")):
        if abs(n) >= size:
            x = n / size
            return (f"{int(x):,}" if x == int(x) else f"{x:,.1f}") + unit
    return f"{n:,}원"


def _spliced(function):
    """A text -> text function as a column function; null stays null."""

    def wrapped(c: str | Column, *rest: str | Column) -> Column:
        @F.pandas_udf("string")
        def run(*cols: pd.Series) -> pd.Series:
            return pd.Series([None if row[0] is None else function(*row) for row in zip(*cols, strict=True)], dtype=object)

        return run(_col(c), *[_col(r) for r in rest])

    wrapped.__name__, wrapped.__doc__, wrapped.plain = function.__name__, function.__doc__, function
    return wrapped


def _percent(m: re.Match) -> str:
    return f"{float(m.group(0)) * 100:.1f}%" if m.group(1).startswith("0") else f"{int(m.group(1))}%"


@_spliced
def units_expanded(text: str) -> str:
    """Numbers followed by a unit word as plain whole numbers."""
    words = "|".join(sorted(_FACTOR, key=len, reverse=True))
    return re.sub(rf"(\d[\d,]*)\s*({words})", lambda m: str(int(m[1].replace(",", "")) * _FACTOR[m[2]]), text)


@_spliced
def table_unit_applied(text: str, unit: str | None) -> str:
    """Every number with commas times the table's unit, unless a unit follows it."""
    factor = next((f for w, f in UNITS if unit and w in unit), 1)
    return re.sub(r"(?<![\d,])(\d{1,3}(?:,\d{3})+)(?!\s*(?:천원|백만원|억원|조원|%|주))", lambda m: str(int(m[1].replace(",", "")) * factor), text)


@_spliced
def large_numbers(text: str) -> str:
    """Numbers of ten or more digits in 조원, 억원 or 만원; from 20 digits, beyond 1000조, marked as errors."""

    def one(m: re.Match) -> str:
        n = int(m[0])
        if len(m[0]) >= 20:
            return ("[데이터오류] " if n > 1000 * 10**12 else "") + f"{n / 10**12:.1f}조원"
        return _amount(n, decimals_of_jo=True)

    return re.sub(r"(?<![0-9.])\d{10,}(?![억만조원%주0-9.])(?!\s*년)", one, text)


@_spliced
def financial_numbers(text: str) -> str:
    """Shares 0.dd as percent, then long, comma and four-digit numbers as amounts; years stay."""
    text = re.sub(r"\b0\.(\d{1,2})\b", _percent, text)
    for pattern in (r"\b\d{8,}(?![억만원%주\d])(?!\s*년)", r"\b\d{1,3}(?:,\d{3})+(?![억만원%주,\d])(?!\s*년)", r"(?<![,\d])\b\d{4,7}(?![억만원%주,\d])(?!\s*년)"):
        text = re.sub(pattern, lambda m: _amount(int(m[0].replace(",", ""))), text)
    return text


@_spliced
def stock_numbers(text: str) -> str:
    """Ratios with a percent sign, counts with 주; years stay."""
    text = re.sub(r"\b0\.(\d{1,2})\b", _percent, text)
    if re.search("율|지분", text):
        text = re.sub(r"(?<![\d.,])(\d{1,3}(?:\.\d+)?)(?![\d%주,.])", r"\1%", text)
    text = re.sub(r"\b(\d{1,3}(?:,\d{3})+)(?![억만원%주,\d])(?!\s*년)", r"\1주", text)
    return re.sub(r"(?<![,\d])(\d{4,})(?![억만원%주,\d])(?!\s*년)", r"\1주", text)


@_spliced
def prose_numbers(text: str) -> str:
    """Units by what the text is about: money, else shares, else ratios; a stated unit multiplies."""
    factor = 1
    if "단위" in text:
        factor = next((f for w, f in UNITS[:3] if w in text.replace(" ", "")), 1)
    if re.search("매출|자산|부채|자본|금액|가격|원", text):
        text = re.sub(rf"\b(\d{{8,}})(?!\d|{_HAS_UNIT}|[-./]\d)", lambda m: f"{int(m[1]) * factor / 10**8:,.0f}억원", text)

        def money(m: re.Match) -> str:
            n = int(m[0].replace(",", "")) * factor
            if n >= 10**8:
                return _amount(n)
            return f"{n // 10**4:,}만원" if n >= 10**4 else f"{n:,}원"

        return re.sub(rf"(?<![-./\d,])\d{{1,3}}(?:,\d{{3}})+(?![\d,]|[-./]|{_HAS_UNIT})", money, text)
    if re.search("주식|주수|보통주|우선주", text):
        text = re.sub(rf"\b(\d{{1,3}}(?:,\d{{3}})+)(?![\d,]|{_HAS_UNIT})(?!\s*년)", r"\1주", text)
        return re.sub(rf"(?<![,\d])(\d{{4,}})(?!\d|{_HAS_UNIT})(?!\s*년)(?![-./]\d)", r"\1주", text)
    if re.search("율|지분|점유", text):
        return re.sub(r"\b0\.\d+\b", lambda m: f"{float(m[0]) * 100:.1f}%", text)
    return text


def structured_value(key: str | Column, value: str | Column) -> Column:
    """A table value without commas, with the unit that its key implies."""
    key, value = _col(key), F.replace(F.regexp_replace(_col(value), r"(?<=\d),(?=\d)", ""), F.lit("%%"), F.lit("%"))
    number = value.rlike(r"^-?\d+(\.\d+)?$")
    return F.when(number & key.rlike("율|지분"), F.concat(value, F.lit("%"))).when(number & key.rlike("주식|주수"), F.concat(value, F.lit("주"))).when(number & key.rlike("금액|가액|자산|부채|자본|매출"), F.concat(value, F.lit("원"))).otherwise(value)
