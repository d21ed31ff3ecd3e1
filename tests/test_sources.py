import io
import json
import time
import zipfile
from html.parser import HTMLParser

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brinework.catalog import QUERIES
from brinework.sources import markup, readers, writers
from brinework.streaming import increments


def test_filing_lists_and_latest_file(spark, tmp_path):
    for day, names in (("20240101", ["a"]), ("20240201", ["b", "c"])):
        (tmp_path / f"{day}.json").write_text(json.dumps({"total_count": 1, "download_date": day, "list": [{"corp_code": n, "corp_name": n, "rcept_no": n} for n in names]}))
    rows = readers.filing_lists(spark, str(tmp_path))
    assert rows.count() == 3
    assert sorted(r.corp_code for r in readers.latest_dated(rows).collect()) == ["b", "c"]


def test_windows_stand_back_to_back(spark):
    rows = readers.filing_windows(spark, "2025-10-20", ["A"]).orderBy(F.desc("end")).collect()
    assert [(r.end - r.start).days for r in rows] == [89] * 4
    assert (rows[0].start - rows[1].end).days == 1


def test_unzip_survives_broken_archives(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.xml", "<a/>")
    rows = spark.createDataFrame([("x.zip", data.getvalue()), ("y.zip", b"no")], "path string, content binary")
    assert sorted((r.path, r.name) for r in readers.unzip(rows).collect() if r.name) == [("x.zip", "a.xml")]


def test_xml_filing_as_markdown():
    xml = "<DOCUMENT><BODY><SECTION-1><TITLE>개요</TITLE><P> 본문  입니다 </P><TABLE><TR><TH COLSPAN='2'>가</TH></TR><TR><TD>나</TD><TD>다|라</TD></TR></TABLE></SECTION-1></BODY></DOCUMENT>"
    assert readers.xml_markdown(xml) == ("# 개요\n\n본문 입니다\n\n| 가 | 가 |\n| --- | --- |\n| 나 | 다\\|라 |", [])


@pytest.mark.parametrize(
    ("xml", "body", "errors"),
    [
        ("<D><SECTION-1><TITLE>개요<P>A & B</P></SECTION-1><P>끝</P></D>", "# 개요A & B\n\n끝", ["bare &", "no end of TITLE"]),
        ("<D><P>하나<P>둘</P></D>", "하나둘", ["no end of P"]),
        ("<D><P>1 < 2 &nbsp;&foo; </P></X></D>", "1 < 2 &foo;", ["bare <", "unknown entity", "no start of X"]),
        ("<D><P>a</P><TABLE><TR><TD COLSPAN=2>x<TD>y</TR></TABLE>", "a\n\n| xy | xy |\n| --- | --- |", ["no end of TD", "no end of TD", "no end of D"]),
        ("no markup & none", "no markup & none", ["bare &"]),
        ("<D><P>&#50864;&#xC6D0;<![CDATA[<&>]]><!-- x --></P><!-- open", "우원<&>", ["bare <", "no end of D"]),
        ("", "", []),
    ],
)
def test_broken_filings_give_their_text(xml, body, errors):
    got = readers.xml_markdown(xml)
    assert (got[0], sorted(e[0] for e in got[1])) == (body, sorted(errors))


def test_filing_documents_tell_what_was_wrong(spark):
    files = spark.createDataFrame([("1_00.xml", "<D><P>a & b</D>"), ("2.xml", "<D><P>ok</P></D>"), ("3.xml", None)], "name string, xml string")
    filings = spark.createDataFrame([("f.json", 0, "1", "Firm")], "file string, seq int, rcept_no string, corp_name string")
    got = {r.rcept_no: (r.body, [e.kind for e in r.errors], r.corp_name) for r in readers.filing_documents(files, filings).collect()}
    assert got == {"1": ("a & b", ["bare &", "no end of P"], "Firm"), "2": ("ok", [], None), "3": (None, [], None)}


@given(st.text(alphabet="<>/&;=\"'a bp!-[]#1?", max_size=60))
def test_no_text_breaks_the_reader(text):
    for html in (False, True):
        root, _ = markup.recovered(text, html)
        assert root.tag == "document"
    # what is told as text, put together, is never longer than what was given
    assert sum(len(e.what) for e in markup.tokens(text) if e.kind == "text") <= len(text)


def test_reading_takes_time_in_proportion():
    for part in ("<!-- ", "<a ", "<a b='", "<![CDATA[ ", "&", "</", "<p><b>", "<?"):
        n = 200_000 // len(part)
        began = time.time()
        assert sum(1 for _ in markup.text_blocks(part * n)) >= 1
        assert time.time() - began < 20


class Naive(HTMLParser):
    """Text of each run with the elements around it, by the standard library's tokens and a plain stack."""

    def __init__(self):
        super().__init__()
        self.stack, self.out, self.last = [], [], None

    def handle_starttag(self, tag, attrs):
        self.last = None
        if tag == "p" and self.stack[-1:] == ["p"]:
            self.stack.pop()
        if tag not in markup.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.last = None

    def handle_endtag(self, tag):
        self.last = None
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_comment(self, data):
        self.last = None

    def handle_data(self, data):
        if self.stack[-1:] not in (["script"], ["style"]):
            if self.last is None:
                self.out.append(["/".join(self.stack), ""])
                self.last = self.out[-1]
            self.last[1] += data


def test_blocks_of_pages_equal_a_naive_reader(spark):
    sf = "/root/testdata/sf0.001"
    got = {}
    for r in QUERIES["page_text_blocks"](spark, sf).where("error is null").orderBy("page_id", "seq").collect():
        got.setdefault(r.page_id, []).append((r.path, r.text))
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        naive = Naive()
        naive.feed(row.html)
        naive.close()
        assert got.get(row.page_id, []) == [(p, " ".join(t.split())) for p, t in naive.out if t.split()]


def test_merged_cells_are_spread():
    assert readers.page_tables("<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [[["a", "b"], ["a", "c"]]]


def test_front_matter(spark):
    row = readers.front_matter(spark.createDataFrame([("---\ncorp_code: 1\nname: a: b\n---\n# T",)], "value string")).first()
    assert (row.front, row.body) == ({"corp_code": "1", "name": "a: b"}, "# T")


def test_jsonl_skips_broken_lines(spark, tmp_path):
    (tmp_path / "a_chunks.jsonl").write_text('{"chunk_id": "1", "natural_text": "x", "metadata": {"fiscal_year": 2024}}\n{broken\n')
    (tmp_path / "other.jsonl").write_text('{"chunk_id": "2"}\n')
    assert [(r.chunk_id, r.metadata.fiscal_year) for r in readers.jsonl_chunks(spark, str(tmp_path)).collect()] == [("1", 2024)]


def test_query_set_company_is_a_list(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "1", "company_name": "a"}, {"query_id": "2", "company_name": ["b", "c"]}, {"query_id": "3"}]))
    assert {r.query_id: r.company_name for r in readers.query_set(spark, str(tmp_path / "q.json")).collect()} == {"1": ["a"], "2": ["b", "c"], "3": None}


def test_partitioned_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, corp string")
    writers.partitioned(rows, str(tmp_path / "t"), ["corp"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    writers.truncate(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0


def test_stream_embeds_only_what_is_new(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "chunk_id string, natural_text string"
    spark.createDataFrame([("a", "one word"), ("b", "two words")], schema).write.parquet(source)
    increments.embed_stream(spark, source, schema, target, mark)
    spark.createDataFrame([("b", "two words"), ("c", "three")], schema).write.mode("append").parquet(source)
    increments.embed_stream(spark, source, schema, target, mark)
    assert sorted(r.chunk_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
