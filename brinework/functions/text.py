"""Text cleaning, keywords and names, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword metrics leave out.
STOP_WORDS = (
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "으로",
    "에서", "부터", "까지", "에게", "한테", "께", "보다", "처럼", "같이", "만큼",
    "조차", "마저", "뿐", "밖에", "외에", "대신", "위해", "통해", "따라",
    "관련", "대한", "대해", "대하", "위한", "통한", "따른",
)

#: What the table-of-contents cleaner removes, in this order.
CONTENTS_PATTERNS = (
    r"\*\*목\s*차\*\*.*?(?=\n\n|\z)",
    r"목\s*차.*?(?=\n\n|\z)",
    r"페\s*이\s*지.*?(?=\n\n|\z)",
    r"독립된\s*감사인의\s*감사보고서.*?\d+\s*~\s*\d+",
    r"연\s*결\s*재\s*무\s*제\s*표.*?\d+",
    r"연\s+결\s+재\s+무\s+제\s+표\s+에\s+대\s+한",
    r"ㆍ\s*연\s*결.*?\d+\s*~\s*\d+",
    r"ㆍ",
    r"외부감사\s*실시내용.*?\d+\s*~\s*\d+",
    r"주석.*?\d+\s*~\s*\d+",
    r"I+\.\s+[가-힣\s]+‥+\s*\d+",
    r"제\s*\d+\s*\([전당]*\)\s*기",
    r"【[^】]*】\s*-+\s*\d+",
    r"(?:^|\n)(?:[IVX]+\.|[0-9\-\.]+)\s+[가-힣\s\(\)]+\s+-+\s*\d+(?:\n[IVX0-9\-\.]+\s+[가-힣\s\(\)]+\s+-+\s*\d+)*",
    r"-{3,}.*?(?=\n\n|\z)",
    r"‥+.*?(?=\n\n|\z)",
)

#: One of these stands in a text, or a dash before a number or dashes, or a line of digits, if a pattern above finds anything.
CONTENTS_SIGNS = ("목", "페", "독", "연", "ㆍ", "외", "주석", "제", "【", "‥")

_WORD = "([가-힣a-zA-Z0-9]+)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Null for the blank markers '' and '-'."""
    c = _col(c)
    return F.when(~c.isin("", "-"), c)


def first_filled(*cols: str | Column) -> Column:
    """The first column that is neither null nor '', else ''."""
    return F.coalesce(*[F.nullif(_col(c).cast("string"), F.lit("")) for c in cols], F.lit(""))


def keywords(c: str | Column, *, min_length: int = 2, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-cased Hangul, Latin and digit runs of at least ``min_length``, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(_WORD), F.lit(1))
    words = F.filter(words, lambda w: F.length(w) >= min_length)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def normalised(c: str | Column) -> Column:
    """Lower case, single blanks, no punctuation; for comparisons of answers."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"\s+", " "), r"[^\p{L}\p{N}_\s]", ""))


def squeezed(c: str | Column) -> Column:
    """One blank for each run of white space, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def tidy_space(c: str | Column) -> Column:
    """Single blanks, at most one empty line, ends trimmed; other line breaks stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), " {2,}", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def special_chars_removed(c: str | Column) -> Column:
    """Only words, blanks and plain punctuation (. , ; : ! ? ( ) -), squeezed."""
    return squeezed(F.regexp_replace(_col(c), r"[^\p{L}\p{N}_\s.,;:!?()\-]", ""))


def category_filtered(c: str | Column) -> Column:
    """Characters outside letters, numbers, blanks and punctuation become blanks."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}\p{Zs}\p{P}]", " ")


def cell_text(c: str | Column) -> Column:
    """A table cell on one line, with its pipes escaped."""
    return F.replace(squeezed(c), F.lit("|"), F.lit("\\|"))


def unmarked(c: str | Column) -> Column:
    """Markdown bold and italic marks removed."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1")


def contents_removed(c: str | Column) -> Column:
    """Tables of contents, page numbers and dotted lines removed."""
    c = _col(c)
    for pattern in CONTENTS_PATTERNS:
        c = F.regexp_replace(c, "(?s)" + pattern, "")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^\s*\d+\s*$", ""), "‥{3,}", "")


def may_have_contents(c: str | Column) -> Column:
    """False only for texts that :func:`contents_removed` leaves as they are; found by plain words, which is faster than trying each pattern."""
    c = _col(c)
    found = c.rlike(r"-(?:\s*\d|--)") | c.rlike(r"(?m)^\s*\d+\s*$")
    for sign in CONTENTS_SIGNS:
        found = F.contains(c, F.lit(sign)) | found
    return found


def html_text(c: str | Column) -> Column:
    """Tags removed, white space squeezed; null gives ''."""
    return squeezed(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "<[^>]+>", " "))


def markdown_tidy(c: str | Column, *, join_words: bool = False) -> Column:
    """Single blanks and none before punctuation; ``join_words`` also drops blanks between word characters."""
    c = F.regexp_replace(squeezed(c), r"\s+([.,!?;:])", "$1")
    return F.regexp_replace(c, r"(?U)(\w)\s+(\w)", "$1$2") if join_words else c


def path_simplified(c: str | Column) -> Column:
    """Numbered path prefixes ``1. title > part:`` as ``title - part:``."""
    return F.regexp_replace(_col(c), r"(?:\d+|[가-힣])\.\s*([^>:\n]+?)\s*>\s*([^:\n]+):", "$1 - $2:")


def prose_tidy(c: str | Column) -> Column:
    """Labels, colons, brackets and line breaks in running text put in order."""
    c = F.regexp_replace(_col(c), r"(\S)\s+(\S)(?=\s*:)", "$1$2")
    c = F.regexp_replace(c, r"\s*:\s*", ": ")
    c = F.regexp_replace(F.regexp_replace(c, r"\s*\(\s*", "("), r"\s*\)\s*", ") ")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {2,}", " ")


def header_text(c: str | Column) -> Column:
    """A heading without its leading number and its brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), r"^\s*[\d.]+\s*", ""), r"\([^)]*\)", ""), r"\s+", " "))


def repetition_reduced(c: str | Column) -> Column:
    """Pairs ``k: k`` dropped, unless k is a number or names a founding, merger or split; commas and colons tidied."""
    c = F.regexp_replace(_col(c), r"(?<![^,:])(?![^,:]*(?:신규|연결|설립|합병|분할))(?![\d ]+:)([^,:]+):\s*\1(?=,|$)", "")
    for pattern, by in ((r"은\(는\)", ""), (r":\s*,(?!\d)", ","), (r",\s*,", ","), (r"^,\s*|\s*,$", ""), (r"\s{2,}", " "), (r"(?<!\d),(?=\s*[^0-9])\s*", ", "), (r":\s+", ": ")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def name_text(c: str | Column) -> Column:
    """A name without byte-order mark and outer blanks."""
    return F.trim(F.replace(_col(c), F.lit("﻿"), F.lit("")))


def without_blanks(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"\s+", "")


def aliases(c: str | Column) -> Column:
    """Spellings of a company name: without its legal form, without blanks; longest first, then by text."""
    c = name_text(c)
    bare = F.trim(F.regexp_replace(c, r"주식회사|\(주\)|㈜", ""))
    every = F.array_distinct(F.filter(F.array(c, bare, without_blanks(c), without_blanks(bare)), lambda x: x != ""))
    return F.transform(F.array_sort(F.transform(every, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def particle(word: str | Column, with_final: str, without_final: str) -> Column:
    """The particle that fits the word's last syllable: Hangul by its final consonant, else by vowel or even digit."""
    word = _col(word)
    last = F.right(word, F.lit(1))
    code = F.ascii(last)
    plain = F.lower(last).isin("a", "e", "i", "o", "u", "0", "2", "4", "6", "8")
    soft = F.when(F.coalesce(word, F.lit("")) == "", True).when(code.between(0xAC00, 0xD7A3), (code - 0xAC00) % 28 == 0).otherwise(plain)
    return F.when(soft, F.lit(without_final)).otherwise(F.lit(with_final))


def sentences(c: str | Column, most: int) -> Column:
    """The first sentences, split after . ! or ? and a blank."""
    return F.concat_ws(" ", F.slice(F.split(F.trim(_col(c)), r"(?<=[.!?])\s+"), 1, most))


def condensed(c: str | Column, *, paragraphs: int = 3, most: int = 8, limit: int = 1000) -> Column:
    """The first paragraphs and sentences, cut at the last blank before ``limit`` with ' ...'."""
    parts = F.slice(F.filter(F.split(F.trim(F.coalesce(_col(c), F.lit(""))), r"\n\s*\n"), lambda p: F.trim(p) != ""), 1, paragraphs)
    text = sentences(F.concat_ws(" ", F.transform(parts, lambda p: squeezed(p))), most)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r"\s\S*$", ""), F.lit(" ...")))


def scaffolding_removed(c: str | Column, *, most: int = 3) -> Column:
    """An answer without prompt headings, at most ``most`` sentences."""
    c = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?s)\[(?:질문|컨텍스트|지시사항|답변)\]\s*", "")
    return sentences(squeezed(c), most)


def labelled_field(c: str | Column, label: str, labels: tuple[str, ...]) -> Column:
    """The value after ``label:`` up to the next of the labels."""
    rest = "|".join(labels)
    return F.trim(F.regexp_extract(_col(c), rf"(?s)(?:^|\n){label}:\s*(.*?)(?=\n(?:{rest}):|\z)", 1))


def zero_width_removed(c: str | Column, *, limit: int | None = None) -> Column:
    c = F.regexp_replace(_col(c), "[​‌‍﻿ ]", "")
    return F.substring(c, 1, limit) if limit else c


def token_estimate(c: str | Column, *, per_token: float = 4) -> Column:
    """Code points divided by ``per_token``, rounded down; null counts 0."""
    return F.floor(F.length(F.coalesce(_col(c), F.lit(""))) / F.lit(per_token)).cast("int")
