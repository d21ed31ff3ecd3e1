"""Table rows as key-value structures and as sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinework.functions.text import _col, particle


def cells(line: str | Column) -> Column:
    """The cells of a Markdown table line; escaped pipes don't part cells."""
    inner = F.regexp_replace(F.trim(_col(line)), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def any_filled(row: Column) -> Column:
    """Whether a row has a cell that is neither '' nor '-'."""
    return F.exists(row, lambda c: ~F.coalesce(c, F.lit("")).isin("", "-"))


def row_map(headers: Column, row: Column) -> Column:
    """header -> value of a row of the same arity, else null; of repeated headers the last wins."""
    pairs = F.arrays_zip(headers.alias("k"), row.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(F.size(headers) == F.size(row), F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"]))))


def vertical_row(row: Column) -> Column:
    """struct<key, value> of a row whose right-most filled cell is the value, under the distinct cells left of it."""
    filled = F.filter(F.transform(row, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: ~s["c"].isin("", "-"))
    value = F.element_at(filled, -1)
    keys = F.array_distinct(F.transform(F.filter(filled, lambda s: s["i"] < value["i"]), lambda s: s["c"]))
    return F.when(F.size(filled) > 1, F.struct(F.array_join(keys, " > ").alias("key"), value["c"].alias("value")))


def has_repeated_header(headers: Column) -> Column:
    return F.size(headers) > F.size(F.array_distinct(headers))


def is_vertical(headers: Column, rows: Column) -> Column:
    """Whether a table reads downwards: two or three columns, labels first, and no repeated value column."""
    narrow = F.size(headers).between(2, 3)
    labels = F.forall(rows, lambda r: ~F.element_at(r, 1).rlike(r"^[\d,.\-%]*$"))
    values = F.exists(rows, lambda r: F.element_at(r, -1).rlike(r"\d"))
    return (narrow & labels & values) | has_repeated_header(headers)


def pairs_text(data: str | Column) -> Column:
    """``key: value`` pairs of the filled values, in the map's order."""
    some = F.filter(F.map_entries(_col(data)), lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "-"))
    return F.array_join(F.transform(some, lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")


def pairs_parsed(text: str | Column) -> Column:
    """The ``key: value`` pairs of a text as a map; parts without a colon are left out, the last of a key wins."""
    parts = F.transform(F.filter(F.split(_col(text), r",\s+"), lambda p: F.contains(p, F.lit(": "))), lambda p: F.split(p, ": ", 2))
    return row_map(F.transform(parts, lambda p: F.trim(p[0])), F.transform(parts, lambda p: F.trim(p[1])))


def merged(*maps: str | Column) -> Column:
    """One map; of a key in several maps the last map's value wins."""
    entries = F.concat(*[F.coalesce(F.map_entries(_col(m)), F.array().cast("array<struct<key:string,value:string>>")) for m in maps])
    return row_map(F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["value"]))


def value_like(data: Column, pattern: str | Column) -> Column:
    """The filled value of the first key that matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.filter(F.map_entries(data), lambda e: F.rlike(e["key"], pattern) & ~F.coalesce(e["value"], F.lit("")).isin("", "-"))
    return F.try_element_at(found, F.lit(1))["value"]


_ITEM = "구분|항목|과목|계정|종류|성명|회사"
#: For each kind of section the key of its subject, the subject without one, and the labels with their keys.
FORMS = (
    ("자기주식", _ITEM, "자기주식", (("기초", "기초"), ("취득", "취득"), ("처분", "처분"), ("소각", "소각"), ("기말", "기말"))),
    ("신용", "평가대상|대상|" + _ITEM, None, (("평가일", "평가일"), ("등급", "등급"), ("평가회사", "평가회사|기관"))),
    ("배당", _ITEM, None, (("당기", "당기"), ("전기", "전기"))),
    ("임원", "성명", None, (("직위", "직위"), ("담당업무", "담당|업무"), ("임기", "임기"))),
    ("사업연도|회계기간", _ITEM, "회계기간", (("시작", "시작|부터"), ("종료", "종료|까지"))),
    ("기업집단|회사.*분류|규모", _ITEM, None, (("유형", "유형"), ("해당 여부", "해당"))),
    ("주식", _ITEM, None, (("주식수", "주식수|수량|총수"), ("비율", "비율|지분"))),
    ("재무|손익|현금흐름", _ITEM, None, (("당기", r"당기|제\s*\d+\s*기"), ("전기", "전기"), ("비고", "비고|주석"))),
)


def sentence(section: str | Column, data: str | Column) -> Column:
    """A sentence for a table row, by its section and keys; null data gives null.

    Treasury stock, credit rating, dividend, executive, fiscal period, company
    size, stock and finance rows have forms of their own; others, and rows
    without the keys that the form needs, are listed as pairs.
    """
    section, d = F.coalesce(_col(section), F.lit("")), _col(data)
    form = None
    for pattern, subject, default, labels in FORMS:
        parts = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(key).alias("key")) for name, key in labels])
        spec = F.struct(F.lit(subject).alias("subject"), F.lit(default).cast("string").alias("otherwise"), parts.alias("labels"))
        form = F.when(section.rlike(pattern), spec) if form is None else form.when(section.rlike(pattern), spec)

    def said(f: Column) -> Column:
        values = F.transform(f["labels"], lambda p: F.concat(p["name"], F.lit(" "), value_like(d, p["key"])))
        return F.struct(F.coalesce(value_like(d, f["subject"]), f["otherwise"]).alias("subject"), F.array_join(values, ", ").alias("body"))

    def built(s: Column) -> Column:
        return F.when(s["subject"].isNotNull() & (s["body"] != ""), F.concat(s["subject"], particle(s["subject"], "은", "는"), F.lit(" "), s["body"], F.lit("입니다.")))

    # one-element arrays name what is used more than once, so it is worked out once
    out = F.transform(F.transform(F.filter(F.array(form), lambda f: f.isNotNull()), said), built)
    return F.coalesce(F.try_element_at(out, F.lit(1)), F.nullif(pairs_text(d), F.lit("")))


#: The header that is told apart where it stands more than once, and its first two names.
REPEATED_HEADER, HEADER_NAMES = "구 분", ("구 분(대)", "구 분(소)")


def merged_header(first: Column, second: Column, first_is_head: Column, second_is_head: Column) -> Column:
    """struct<header, merged> of a table's two first rows, each with a flag per cell.

    Where at least half of the cells of both rows are header cells they become
    one header: the second row's text where it has any, else the first's, and
    the first two of a repeated 구 분 get names of their own.  Otherwise, or
    without a second row, the header is the first row.
    """

    def heads(flags: Column) -> Column:
        return F.coalesce((F.size(flags) > 0) & (F.size(F.filter(flags, lambda f: f)) * 2 >= F.size(flags)), F.lit(False))

    def filled(c: Column) -> Column:
        return F.when(F.trim(c) != "", c)

    both = second.isNotNull() & heads(first_is_head) & heads(second_is_head)
    one = F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), lambda p: F.coalesce(filled(p["b"]), filled(p["a"]), F.lit("")))
    # told apart by place: positions of the repeated header, from one
    same = F.transform(one, lambda c: F.regexp_replace(c, r"^구 {1,2}분$", REPEATED_HEADER))
    at = F.filter(F.transform(same, lambda c, i: F.when(c == REPEATED_HEADER, i + 1)), lambda i: i.isNotNull())
    named = F.transform(same, lambda c, i: F.when((F.size(at) > 1) & (i + 1 == F.try_element_at(at, F.lit(1))), HEADER_NAMES[0]).when(i + 1 == F.try_element_at(at, F.lit(2)), HEADER_NAMES[1]).otherwise(c))
    return F.struct(F.when(both, named).otherwise(first).alias("header"), both.alias("merged"))
