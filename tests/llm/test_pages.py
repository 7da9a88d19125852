"""HTML rendering and WARC derivatives."""

import base64
import gzip
import hashlib
import time
import zlib

import pytest

from vecrec.llm import warc
from vecrec.llm.html_text import extract_text, render


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<title>no</title><p>one<p>two <b>bold</b>\n  text", "one\n\ntwo bold text"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><td>1<td>long one<tr><th colspan=2>over both<tr><td>333<td>4</table>", "1    long one\nover both\n333  4"),
        ("a<pre>\n x\n   y</pre>b<hr>c", "a\n\n x\n   y\n\nb\n---\nc"),
        ("<div hidden>no</div><p style='display: none'>no</p><input type=hidden><span style=\"visibility:hidden\">no</span>yes", "yes"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no --> x &lt; 3 &amp; y<br>z", "x < 3 & y\nz"),
        ("<a title='a > b'>t</a> 1 < 2 </nothing> <p>q</div>r", "t 1 < 2\n\nqr"),
        ("<dl><dt>term<dd>meaning<dt>other<dd>more</dl>", "term\n  meaning\nother\n  more"),
        ("<html><head><meta charset=x><p>body at once", "body at once"),
        ("<blockquote>said<div>twice</div></blockquote>", "  said\n  twice"),
        ("", ""),
        (None, ""),
    ],
)
def test_rendering(page, text):
    assert render(page) == text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table>stray <b>in</b> table<tr><td>a</table>", "stray in table\na"),
        ("<table><tbody>stray<tr> <td>a</td> <td>b</td> </tr></table>", "stray\na  b"),
        ("<table><tr>no cell</tr><tr><td>a</td>after</tr></table>", "no cell\na  after"),
        ("<table>" * 300 + "x", "x"),
        ("<div>" * 197 + "<table><tr><td>deep <i>cell</i></td></tr></table>", "  deep cell"),
        ("<div title='now hidden here'>a</div><p data-x=\"style='display:none'\">b</p><a href='?type=hidden' alt=\" type=hidden \">c</a>", "a\n\nb\n\nc"),
        ("<p data-style='display:none'>a</p><p aria-hidden=true>b</p><button type=hidden>c</button>", "a\n\nb\n\nc"),
        ("<p title=x hidden>no</p><p STYLE='color:red; Display : none !important'>no</p><p hidden=''>no</p><tt style=visibility:collapse>no</tt>yes", "yes"),
    ],
)
def test_all_visible_text_comes_out(page, want):
    assert render(page) == want


@pytest.mark.parametrize("page", ["<" * 3000, "<div>" * 4000 + "deep", "<a href=\"x>y</a> z" * 200, "<!-- never", "<p", "</", "<script>a<b", "<table>" * 300 + "x", "<td>x</table>" * 300, "<textarea><p>kept", "\x00<b>�"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(render(page), str)
    assert "deep" in render(page) or "deep" not in page


@pytest.mark.parametrize("page", ["<a b='" * 160_000, "<a b='" * 160_000 + ">", "<a b=\">\" " * 90_000 + "'", "<" + "a" * 1_000_000 + " b='>", "<" * 1_000_000, "<!" * 500_000, "<div>" * 200_000, "<p><button>" + "<div>" * 200_000, "<p>" * 300_000, "<a \">x" * 150_000])
def test_a_megabyte_of_open_quotes_and_tags_takes_a_moment(page):
    before = time.process_time()
    assert isinstance(render(page), str)
    assert time.process_time() - before < 10


def test_nothing_hidden_comes_out_of_any_depth():
    for depth in (10, 198, 199, 200, 201, 260, 5000):
        page = "<div>" * depth + "<div hidden>secret<div>secret</div><p>secret</div>shown<svg><g>secret</g></svg><p style='display:none'>secret</p>" + "</div>" * depth + "<p>end"
        assert render(page).split() == ["shown", "end"], depth


def test_payloads_without_their_codings():
    page = b"<p>caf\xc3\xa9 " + b"x" * 3000
    chunked = b"".join(b"%x;q=1\r\n%s\r\n" % (len(page[k : k + 700]), page[k : k + 700]) for k in range(0, len(page), 700)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    for http, body in (
        ({}, page), ({"transfer-encoding": "chunked"}, chunked), ({"content-encoding": "gzip"}, gzip.compress(page)), ({"content-encoding": "deflate"}, zlib.compress(page)),
        ({"content-encoding": "deflate"}, raw.compress(page) + raw.flush()), ({"content-encoding": "gzip"}, page), ({"transfer-encoding": "chunked"}, page), ({"content-encoding": "br"}, page),
        ({"transfer-encoding": "chunked", "content-encoding": "gzip"}, b"%x\r\n%s\r\n0\r\n\r\n" % (len(gzip.compress(page)), gzip.compress(page))),
    ):
        assert warc.payload(body, http) == page
    assert page.startswith(warc.payload(gzip.compress(page)[:-20], {"content-encoding": "gzip"})) and warc.payload(b"", {"content-encoding": "gzip", "transfer-encoding": "chunked"}) == b""


def test_whole_gzip_members_come_out_of_a_cut_file():
    one, two = (warc.response(f"http://x/{k}", f"<p>{k}", k, "2020-01-01T00:00:00Z") for k in (1, 2))
    whole = gzip.compress(one) + gzip.compress(two)
    assert len(list(warc.records(whole))) == 2
    for cut in (len(gzip.compress(one)), len(gzip.compress(one)) + 1, len(gzip.compress(one)) + 40, len(whole) - 9):
        assert [h["WARC-Target-URI"] for h, _ in warc.records(whole[:cut])][:1] == ["http://x/1"]
    assert len(list(warc.records(gzip.compress(one)[:30]))) == 0


def test_the_text_of_a_page_is_returned(spark):
    pages = spark.createDataFrame([(1, "http://x/1", "<p>é one<p>two")], "page_id bigint, url string, html string")
    got = {r.kind: r.text for r in warc.page_derivatives(pages, keep_records=False).collect()}
    assert got == {"metadata": None, "conversion": "é one\n\ntwo"}


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "<p>a", "k"), (1, "<p>a", "k"), (None, None, None), (2, "", "k")], "page_id bigint, html string, key string")
    assert sorted(map(tuple, extract_text(pages).collect()), key=repr) == sorted([(1, "a"), (1, "a"), (None, ""), (2, "")], key=repr)
    assert extract_text(pages.limit(0)).count() == 0


def test_derivatives_name_their_source(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<title>T &amp; U</title><p>hé</p>", "k"), (2, None, None, "k"), (2, None, None, "k"), (None, "http://b.org", "", None)], "page_id bigint, url string, html string, record string")
    made = warc.page_derivatives(pages)
    rows = made.collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6  # a repeated row gives the same ids
    for r in rows:
        (headers, block), = warc.records(r.record)
        assert headers["WARC-Type"] == r.kind and headers["WARC-Refers-To"] == r.refers_to and headers["WARC-Source-Payload-Digest"] == r.source_digest
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() == r.block_digest
    first = {r.kind: r for r in rows if r.page_id == 1}
    assert next(warc.records(first["conversion"].record))[1].decode() == "hé"
    assert b"title: T & U\r\n" in first["metadata"].record
    source = warc.response("http://a.org/x", "<title>T &amp; U</title><p>hé</p>", 1, "1970-01-01T00:00:00Z")
    assert next(warc.records(source))[0]["WARC-Record-ID"] == first["metadata"].refers_to
    # records in bytes, plain, gzipped, several, cut off, and of other types
    kept = spark.createDataFrame([(1, source), (2, gzip.compress(source) + gzip.compress(source)), (3, source[:-40]), (4, None), (5, b""), (6, b"junk"), (7, first["metadata"].record)], "id bigint, record binary")
    assert sorted(r.id for r in warc.derivatives(kept, "id").collect()) == [1, 1, 2, 2, 2, 2]
    files = warc.write_warc(made, folder=str(tmp_path / "warc"))
    back = [bytes(r.record) for r in warc.read_warc(files).collect()]
    assert sorted(back) == sorted(bytes(r.record) for r in rows)
    assert warc.page_derivatives(pages.limit(0)).count() == 0
