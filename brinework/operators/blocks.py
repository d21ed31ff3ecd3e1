"""Markdown documents to blocks: paragraphs and table rows, one fold over the lines of each document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

from brinework.functions.numbers import UNITS, table_unit_applied, units_expanded

#: Words of units that are no money, cells that tell of a table read row by row, and signs of a label.
NO_MONEY = ("Ton", "%", "리터", "개", "주", "건", "명", "회")
ROW_WORDS = ("말", "초", "부터", "까지", "시작일", "종료일")
LABEL_SIGNS = ("일", "자", "액", "명", "율", "목")
#: Lines above a table among which its unit is looked for, and rows whose first cells are judged.
UNIT_LINES, JUDGED_ROWS = 3, 5
_UNIT = re.compile(r"단위\s*[:：\s]\s*([^)/]+)")
_DATA = re.compile(r"\d{4}년|\d+[,.]\d+")
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
EMPTY = ("", "-")


def cells(line: str) -> list[str]:
    """The cells of a table line; escaped pipes don't part cells."""
    inner = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", inner)]


def money_unit(lines: list[str]) -> str:
    """The unit of money named in the lines, the last one first; '' for none."""
    for line in reversed(lines):
        if m := _UNIT.search(line):
            unit = m[1].strip()
            if "원" in unit and not any(w in unit for w in NO_MONEY):
                return unit
    return ""


def is_data(cell: str) -> bool:
    """Whether a cell holds a value: bold text, a number, or a date."""
    return "**" in cell or bool(_DATA.match(cell)) or cell.replace(",", "").replace("-", "").isdigit()


def is_vertical(headers: list[str], rows: list[list[str]]) -> bool:
    """Whether each row of a table is a label with its value, instead of values under headers.

    So it is where the header or the first row begins with a number and a dot,
    the header with 제 and a number, the first row has two words such as 부터 and
    까지, a header stands twice, or a table of two or three columns has labels
    in at least half of its first cells.
    """
    first = rows[0] if rows else []
    if headers and re.match(r"\d+\.|제\s*\d+", headers[0]) or first and re.match(r"\d+\.", first[0]):
        return True
    if len(first) > 1 and sum(c in ROW_WORDS for c in first) >= 2:
        return True
    named = [h for h in headers if h]
    if len(headers) >= 2 and len(named) > len(set(named)):
        return True
    labels = [r[0] for r in rows[:JUDGED_ROWS] if r]
    like = sum(any(s in c for s in LABEL_SIGNS) or c.endswith("여부") for c in labels)
    return 2 <= len(headers) <= 3 and bool(labels) and 2 * like >= len(labels)


def labelled_value(row: list[str]) -> tuple[str, str] | None:
    """(label, value): the last cell that holds a value, under the distinct cells before it; None for rows without either."""
    at = next((i for i in range(len(row) - 1, -1, -1) if is_data(row[i])), None)
    if at is None:
        return None
    label = " > ".join(dict.fromkeys(c for c in row[:at] if c not in EMPTY))
    value = row[at].replace("**", "").strip()
    return (label, value) if label and value not in EMPTY else None


def in_units(text: str, unit: str) -> str:
    """Numbers with a unit word as whole numbers, and a number alone or numbers with commas times the table's unit."""
    text = units_expanded.plain(text)
    factor = next((f for w, f in UNITS if w in unit.replace(" ", "")), 1)
    number = text.replace(",", "").replace(" ", "")
    if factor > 1 and re.fullmatch(r"-?\d+(\.\d+)?", number):
        return str(int(Decimal(number) * factor))
    return table_unit_applied.plain(text, unit.replace(" ", "")) if factor > 1 else text


def document_blocks(body: str) -> Iterator[tuple[int, str, str, str | None, dict | None, dict | None, str]]:
    """(line, section path, kind, text, data, data in units, unit) of the blocks of one document, in order.

    Paragraphs end at tables, headings and blank lines and need more than ten
    characters.  A row of a vertical table is ``label: value`` in units; other
    rows need as many cells as the header and one filled one, and have no text
    yet.  Of repeated headers the last one's value counts.
    """
    stack: list[str] = []
    lines = body.split("\n")
    at = 0
    while at < len(lines):
        line, path = lines[at], " > ".join(stack)
        if m := _HEADING.match(line):
            stack = [*stack[: len(m[1]) - 1], m[2].strip()]
            at += 1
        elif line.startswith("|"):
            end = at
            while end < len(lines) and lines[end].startswith("|"):
                end += 1
            unit = money_unit(lines[max(0, at - UNIT_LINES) : at])
            headers, rows = cells(line), [cells(x) for x in lines[at + 2 : end]]
            vertical = is_vertical(headers, rows)
            for number, row in enumerate(rows, at + 2):
                if vertical and (pair := labelled_value(row)):
                    label, value = (in_units(x, unit) for x in pair)
                    yield number, path, "table_row", f"{label}: {value}", dict([pair]), {label: value}, unit
                elif not vertical and len(row) == len(headers) and any(c not in EMPTY for c in row):
                    data = dict(zip(headers, row, strict=True))
                    yield number, path, "table_row", None, data, {k: in_units(v, unit) for k, v in data.items()}, unit
            at = end
        elif not line.strip():
            at += 1
        else:
            end = at
            while end < len(lines) and lines[end].strip() and not lines[end].startswith("|") and not _HEADING.match(lines[end]):
                end += 1
            if len(text := "\n".join(lines[at:end])) > 10:
                yield at, path, "text", text, None, None, ""
            at = end


def section_name(path: str) -> str:
    """The last element of a path in word characters, at most ten."""
    return re.sub(r"\W", "", path.split(" > ")[-1])[:10]


def merged(rows: list[dict], budget: int) -> list[dict]:
    """Neighbouring rows of one section and kind joined while their tokens fit the budget; a larger row is alone."""
    out: list[dict] = []
    room = 0
    for r in rows:
        last = out[-1] if out else None
        if last and (last["section_path"], last["chunk_type"]) == (r["section_path"], r["chunk_type"]) and r["tokens"] <= room:
            last["texts"].append(r["text"])
            room -= r["tokens"]
        else:
            out.append(r | {"texts": [r["text"]]})
            room = budget - r["tokens"]
    return [r | {"text": "\n".join(r["texts"]), "merged_count": len(r["texts"])} for r in out]


def shortened(text: str, words: int = 100) -> str:
    """The first words of a text, '...' where it is cut."""
    parts = text.split(" ", words)
    return " ".join(parts[:words]) + "..." if len(parts) > words else text


def numbered(document: str, rows: list[dict]) -> list[dict]:
    """Rows of one document with an id that counts its kind and the beginnings of the rows beside."""
    count: dict[str, int] = {}
    for i, r in enumerate(rows):
        n = count[r["chunk_type"]] = count.get(r["chunk_type"], -1) + 1
        r["chunk_id"] = f"{document}_{r['chunk_type']}_{section_name(r['section_path'])}_{n:03d}"
        r["prev_context"] = shortened(rows[i - 1]["text"]) if i else None
        r["next_context"] = shortened(rows[i + 1]["text"]) if i + 1 < len(rows) else None
    return rows
