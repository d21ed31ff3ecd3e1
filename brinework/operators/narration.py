"""Sentences for table rows, one form for each kind of section.

A row is a map of header to value.  Values that are null, '' or '-' count as
absent, clauses without their value are left out, and a form without any of
its values gives null.  Where several keys fit, the first in the map's order counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinework.functions.dates import iso_dates
from brinework.functions.numbers import amount, with_unit
from brinework.functions.text import _col, blank_to_null, particle
from brinework.operators.structured import pairs_text, value_like

#: The kinds of company that a classification names, in order of precedence.
COMPANY_KINDS = ("중소기업", "중견기업", "벤처기업")
#: The keys of a financial row's item and of its footnote.
ITEM_KEYS = ("과목", "과 목", "항목", "구분")
NOTE_KEYS = ("주석", "주 석")
#: Words that stand where a fiscal year would.
YEAR_LABELS = ("부터", "까지", "사업연도")
_DATE = "년.*월.*일"


def named(data: Column, *keys: str) -> Column:
    """The first filled value among the keys."""
    return F.coalesce(*[blank_to_null(F.try_element_at(data, F.lit(k))) for k in keys])


def _clause(before: str | Column, value: Column, after: str) -> Column:
    return F.concat(F.lit(before) if isinstance(before, str) else before, value, F.lit(after))


def _joined(*clauses: Column, least: int = 1) -> Column:
    """The clauses that aren't null with blanks between; null if there are fewer than ``least``."""
    some = F.array_compact(F.array(*clauses))
    return F.when(F.size(some) >= least, F.array_join(some, " "))


def _digits(value: Column) -> Column:
    """Whether a text is a whole number, commas allowed."""
    return F.regexp_replace(value, ",", "").rlike(r"^\d+$")


def _percent(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("%")), value).otherwise(F.concat(value, F.lit("%")))


def single_item(data: Column) -> Column:
    """``key: value`` of a one-entry row, its date, shares, amount or ratio in standard form."""
    entry = F.try_element_at(F.map_entries(data), F.lit(1))
    key, value = entry["key"], entry["value"]
    shares = F.replace(value, F.lit("주"), F.lit(""))
    shown = (
        F.when(value.rlike(r"^\d{4}년\s*\d{1,2}월\s*\d{1,2}일"), iso_dates(value))
        .when(F.contains(key, F.lit("주식")) & _digits(shares), with_unit(shares, "주"))
        .when(F.contains(key, F.lit("금액")) & _digits(value), amount(value))
        .when(F.contains(key, F.lit("비율")) & value.rlike(r"^[\d,.]+%?$"), _percent(value))
        .otherwise(value)
    )
    return F.concat(key, F.lit(": "), shown)


def treasury_stock(data: Column, company: Column) -> Column:
    """A trust contract for own shares: decision, amount, period, purpose, broker and holdings."""
    start, end = iso_dates(value_like(data, "시작일|개시")), iso_dates(value_like(data, "종료일|만료"))
    price, shares = value_like(data, "계약금액|금액.*계약|계약.*금액"), F.replace(value_like(data, "보통주식"), F.lit("주"), F.lit(""))
    decided = iso_dates(value_like(data, "결정일|예정일자"))
    subject = F.concat(company, particle(company, "은", "는"), F.lit(" "))
    held = F.array_compact(F.array(F.when(_digits(shares), with_unit(shares, "주")), _clause("비율 ", _percent(value_like(data, "비율")), "")))
    many = _joined(
        F.coalesce(F.concat(subject, decided, F.lit("에 자기주식 취득 신탁계약 체결을 결정했습니다.")), F.concat(subject, F.lit("자기주식 취득 신탁계약을 체결했습니다."))),
        _clause("계약금액은 ", F.when(_digits(price), amount(price)), "입니다."),
        F.coalesce(F.concat(F.lit("계약기간은 "), start, F.lit("부터 "), end, F.lit("까지입니다.")), _clause("계약 시작일은 ", start, "입니다.")),
        _clause("취득 목적은 '", value_like(data, "목적"), "'입니다."),
        _clause("계약체결기관은 ", value_like(data, "체결기관|중개업자"), "입니다."),
        F.when(F.size(held) > 0, _clause("계약 전 자기주식 보유현황은 ", F.array_join(held, ", "), "입니다.")),
    )
    return F.when(F.size(data) == 1, single_item(data)).otherwise(many)


def credit_rating(data: Column, company: Column) -> Column:
    got = _joined(
        _clause("", iso_dates(named(data, "평가일")), "에"),
        _clause("", named(data, "신용평가기관"), "로부터"),
        _clause("", named(data, "신용등급"), " 등급을"),
        _clause("", named(data, "평가목적"), " 목적으로"),
        _clause("(", named(data, "평가구분"), ")"),
    )
    return F.concat(company, F.lit("는 "), got, F.lit(" 받았습니다."))


def period_label(key: Column) -> Column:
    """``제27기(당기) 말`` of a header of a term's begin or end, ``2024년`` of one with a year, else null."""
    number = F.nullif(F.regexp_extract(key, r"제\s*(\d+)", 1), F.lit(""))
    which = F.when(F.contains(key, F.lit("당")), "(당기)").when(F.contains(key, F.lit("전")), "(전기)").otherwise("")
    term = F.concat(F.lit("제"), number, F.lit("기"), which, F.when(F.contains(key, F.lit("기말")), " 말").otherwise(" 초"))
    year = F.when(F.contains(key, F.lit("년")) | key.rlike(r"^\d{4}"), F.concat(F.nullif(F.regexp_extract(key, r"\d{4}", 0), F.lit("")), F.lit("년")))
    return F.when(key.rlike("기말|기초"), term).otherwise(year)


def financial(data: Column, company: Column | None = None) -> Column:
    """An item with its amounts by period and its footnote; null without an amount whose header names a period."""
    filled = F.filter(F.map_entries(data), lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "-"))
    other = F.filter(filled, lambda e: ~e["key"].rlike(r"기말|기초|년|주석|주 석") & ~e["value"].rlike(r"^[\d,.]+$"))
    item = F.coalesce(named(data, *ITEM_KEYS), F.try_element_at(other, F.lit(1))["value"])
    numbers = F.filter(filled, lambda e: ~e["key"].isin(*ITEM_KEYS, *NOTE_KEYS) & e["value"].rlike(r"^[\d,.]*\d[\d,.]*$"))
    amounts = F.array_compact(F.transform(numbers, lambda e: F.concat(period_label(e["key"]), F.lit(" "), amount(e["value"]))))
    listed = F.array_join(amounts, ", ")
    body = F.coalesce(F.concat(item, F.lit("은(는) "), listed, F.lit("입니다")), listed)
    return F.when(F.size(amounts) > 0, F.concat(body, F.coalesce(_clause(" (주석 ", named(data, *NOTE_KEYS), ")"), F.lit(""))))


def stock(data: Column, company: Column) -> Column:
    return _joined(
        F.concat(company, F.lit("의 "), named(data, "구 분", "구분", "주식종류"), F.lit("은(는)")),
        _clause("", with_unit(named(data, "주식수", "발행주식수"), "주"), "이며"),
        _clause("금액은 ", amount(named(data, "금액", "발행금액")), "입니다"),
    )


def dividend(data: Column, company: Column) -> Column:
    got = _joined(
        F.concat(company, F.lit("는 "), named(data, "결산기", "사업연도"), F.lit(" 결산기에")),
        _clause("주당 ", with_unit(named(data, "주당배당금", "배당금"), "원"), "을"),
        _clause("배당률 ", named(data, "배당률", "배당수익률"), "%로"),
    )
    return F.concat(got, F.lit(" 지급했습니다"))


def executive(data: Column, company: Column | None = None) -> Column:
    """Name, position and appointment; null with fewer than two of them."""
    return _joined(
        _clause("", named(data, "성명", "이름"), "은(는)"),
        _clause("", named(data, "직위", "직책"), "으로"),
        _clause("", iso_dates(named(data, "취임일", "선임일")), "에 취임했습니다"),
        least=2,
    )


def fiscal_period(data: Column, company: Column) -> Column:
    """Begin and end of a fiscal year, each a key or a value beside its mark, or the year alone."""
    filled = F.filter(F.map_entries(data), lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "-"))
    span = F.try_element_at(F.filter(filled, lambda e: e["key"].rlike(_DATE) & e["value"].rlike("년.*월")), F.lit(1))

    def marked(mark: str, words: str) -> Column:
        beside = F.transform(
            F.filter(filled, lambda e: ((e["value"] == mark) & e["key"].rlike("년.*월")) | (e["key"].rlike(words) & F.contains(e["value"], F.lit("년")))),
            lambda e: F.when(e["value"] == mark, e["key"]).otherwise(e["value"]),
        )
        return F.try_element_at(beside, F.lit(1))

    start = iso_dates(F.coalesce(span["key"], marked("부터", "부터|시작")))
    end = iso_dates(F.coalesce(span["value"], marked("까지", "까지|종료|만료")))
    year = F.try_element_at(F.filter(filled, lambda e: F.contains(e["key"], F.lit("사업연도")) & ~e["value"].isin(*YEAR_LABELS)), F.lit(1))["value"]
    whole = F.concat(company, F.lit("의 "), F.left(start, F.lit(4)), F.lit("년도 사업연도는 "), start, F.lit("부터 "), end, F.lit("까지입니다."))
    return F.coalesce(whole, F.concat(company, F.lit("의 사업연도는 "), year, F.lit("입니다.")))


def company_size(data: Column, company: Column) -> Column:
    """The kinds of company that a row says the company is or isn't, each once in the row's order."""

    def kind(c: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(c, F.lit(k)), k) for k in COMPANY_KINDS])

    def applies(c: Column) -> Column:
        return F.when(F.contains(c, F.lit("해당")), ~F.contains(c, F.lit("미해당")))

    filled = F.filter(F.map_entries(data), lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "-"))
    said = F.transform(filled, lambda e: F.struct(F.coalesce(kind(e["value"]), kind(e["key"])).alias("kind"), F.coalesce(applies(e["value"]), applies(e["key"])).alias("yes")))

    def listed(flag: bool) -> Column:
        names = F.array_distinct(F.transform(F.filter(said, lambda s: s["kind"].isNotNull() & (s["yes"] == flag)), lambda s: s["kind"]))
        return F.when(F.size(names) > 0, F.array_join(names, ", "))

    yes, no, subject = listed(True), listed(False), F.concat(company, F.lit("는 "))
    first = F.concat(subject, yes, F.lit("에 해당합니다"))
    second = F.when(yes.isNull(), F.concat(subject, no, F.lit("에 해당하지 않습니다"))).otherwise(F.concat(no, F.lit("에는 해당하지 않습니다")))
    return F.nullif(F.concat(F.concat_ws(". ", first, second), F.lit(".")), F.lit("."))


def narrated(section: str | Column, data: str | Column, company: str | Column | None = None, *, listed: bool = True) -> Column:
    """The sentence of a row by its section and keys; the first form that fits and has its values.

    Rows that no form fits are listed as ``key: value`` pairs, or null with
    ``listed=False``.  Null or empty data gives null; a null or empty company
    is called 회사, a null section fits no form by section.
    """
    section, d = F.coalesce(_col(section), F.lit("")), _col(data)
    firm = F.lit("회사") if company is None else F.coalesce(F.nullif(_col(company), F.lit("")), F.lit("회사"))
    keys, values = F.map_keys(d), F.map_values(d)
    kinds = "|".join(COMPANY_KINDS)
    forms = (
        (F.contains(section, F.lit("자기주식")) & section.rlike("취득|신탁"), treasury_stock),
        (F.contains(section, F.lit("신용평가")) | F.exists(keys, lambda k: k.isin("신용등급", "신용평가기관")), credit_rating),
        (F.exists(keys, lambda k: F.contains(k, F.lit("사업연도")) | k.rlike(_DATE)), fiscal_period),
        (F.exists(keys, lambda k: k.rlike(kinds)) | F.exists(values, lambda v: F.coalesce(v, F.lit("")).rlike(kinds)), company_size),
        (F.replace(section, F.lit(" "), F.lit("")).rlike("재무|손익|자산|부채"), financial),
        (F.contains(section, F.lit("주식")), stock),
        (F.contains(section, F.lit("배당")), dividend),
        (section.rlike("임원|이사"), executive),
    )
    said = F.coalesce(*[F.when(fits, form(d, firm)) for fits, form in forms])
    if listed:
        said = F.coalesce(said, F.nullif(pairs_text(d), F.lit("")))
    return F.when(F.size(d) > 0, said)
