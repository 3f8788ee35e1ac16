"""Archives round trip and ZIP forms; main text of pages of several layouts; exact token counts."""

import gzip
import hashlib
import base64
import html
import io
import re
import struct
import zipfile

import pytest
import tiktoken
from pyspark.sql import functions as F

import edges
from vigie.llm import archives, html_text, tokens
from vigie.llm.queries import QUERIES
from vigie.session import fresh_folder

SF_DIR = "/root/testdata/sf0.01"


def plain_records(rows, least=0):
    out = []
    for key, page in rows:
        data = (page or "").encode()
        same = [k for k, p in rows if (p or "").encode() == data and k is not None]
        last = max(same) if same and sum((p or "").encode() == data for _, p in rows) > 1 else None
        revisit = last is not None and key != last and len(data) >= least
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def test_warc_query(spark):
    found = sorted((tuple(r) for r in QUERIES["op4_warc"](spark, SF_DIR).collect()), key=repr)
    assert found == plain_records(edges.given_rows(SF_DIR, "pages", "page_id", "html"))


PAGES = [
    (1, "http://a/", "<p>same</p>", "x"), (5, "http://b/\r\nX-Evil: 1", "<p>same</p>", "x"), (5, None, "<p>same</p>", "x"),
    (2, "http://c/", None, "x"), (3, "http://d/", "", "x"), (None, "http://e/", "<p>same</p>", "x"), (None, "http://f/", "own", "x"),
    (7, "http://g/ü", "日本 \r\n\r\n WARC/1.1", "x"), (8, "http://h/", "long " * 60_000, "x"), (9, "http://h/", "long " * 60_000, "x"),
]
PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING, record_type STRING"


@pytest.mark.parametrize("least", [0, 100])
def test_warc_edges(spark, least):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    found = archives.roundtrip(pages, min_bytes=least).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr)
    assert got == plain_records([(k, p) for k, _, p, _ in PAGES], least)
    texts = {r.page_id: r.payload for r in found if r.record_type == "response" and r.page_id is not None}
    assert texts[7] == PAGES[7][2] and texts[9] == PAGES[9][2]
    assert archives.roundtrip(pages.limit(0)).count() == 0


def test_small_packages(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(100)], "page_id BIGINT, url STRING, html STRING")
    packages = archives.write_packages(pages.coalesce(1), str(tmp_path), package_bytes=3000)
    assert packages.count() > 3 and packages.agg(F.sum("records")).first()[0] == 100
    assert sorted(r.page_id for r in archives.read_packages(packages, str(tmp_path)).collect()) == list(range(100))


def test_zip64_comments_and_deflated_index():
    packed = [gzip.compress(f"record {i}".encode()) for i in range(3)]
    data, index = b"".join(packed), []
    for p in packed:
        index.append(f'{{"offset": {data.index(p)}, "length": {len(p)}}}')
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr(archives.DATA, data)
        z.writestr(archives.INDEX, "\n".join(index), zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 inside, long enough to hold a record"
    plain = sink.getvalue()
    reader = archives.PackageReader(io.BytesIO(plain), len(plain))
    assert list(reader.records()) == [b"record 0", b"record 1", b"record 2"]
    # The same file with a wide directory: every narrow field full, the values in extra fields and end records.
    at = plain.rindex(archives.END, 0, len(plain) - len(b"inside, long enough to hold a record") - 10)
    size, start = struct.unpack("<II", plain[at + 12:at + 20])
    wide, i = b"", start
    while plain[i:i + 4] == archives.ENTRY:
        n, extra_n, note_n = struct.unpack("<HHH", plain[i + 28:i + 34])
        p, s = struct.unpack("<II", plain[i + 20:i + 28])
        header = struct.unpack("<I", plain[i + 42:i + 46])[0]
        extra = struct.pack("<HHQQQ", 1, 24, s, p, header)
        wide += plain[i:i + 20] + b"\xff" * 8 + struct.pack("<HHH", n, len(extra), 0) + plain[i + 34:i + 42] + b"\xff" * 4
        wide += plain[i + 46:i + 46 + n] + extra
        i += 46 + n + extra_n + note_n
    end64 = archives.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 2, 2, len(wide), start)
    locator = archives.LOCATOR + struct.pack("<IQI", 0, start + len(wide), 1)
    full = plain[:start] + wide + end64 + locator + archives.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    reader = archives.PackageReader(io.BytesIO(full), len(full))
    assert list(reader.records()) == [b"record 0", b"record 1", b"record 2"]
    with pytest.raises(ValueError):
        archives.PackageReader(io.BytesIO(b"no zip"), 6)


def test_html_query(spark):
    found = {r.page_id: r for r in QUERIES["op3_html_extraction"](spark, SF_DIR).collect()}
    pages = edges.given_rows(SF_DIR, "pages", "page_id", "html")
    assert len(found) == len(pages)
    for key, page in pages:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        wanted = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert found[key].text == wanted and found[key].n_chars == len(wanted)


WORDS = "It was a long and quiet afternoon, and nobody in the whole village wanted to work any more. "


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(html_text.labelled_blocks(spark))


@pytest.mark.parametrize(("page", "wanted"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("<script>var x = '<p>no</p>';</script>", ""), ("<!-- <p>no</p>", ""),
    (f"<p>{WORDS}</p>", WORDS.strip()),
    (f"<article><p>a&amp;b &lt;c&gt; &#233;&nbsp;&#x4e2d;</p>\n<p> x \n\t y<br>z</p></article>", "a&b <c> é 中 x y z"),
    (f"<article><header><h1>Head</h1></header><p>One</p><aside>no</aside><div class='ad-box'>no</div><p>Two</p></article>"
     f"<section id=comments><p>{WORDS}</p></section>", "Head One Two"),
    (f"<body class='has-sidebar'><header><a href=/>Home</a><p>{WORDS}</p></header><div id='main-content'><h1>T</h1><p>{WORDS}</p><p>Short.</p>"
     f"<form><label>Name</label><input></form></div><div class='sidebar'><p>{WORDS}</p></div><div id='footer'>{WORDS}</div>",
     f"T {WORDS.strip()} Short."),
    (f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><h1>Title</h1><p>{WORDS}<p>{WORDS}<p>Tiny.<p>{WORDS}</div><div class=footer>c</div>",
     f"Title {WORDS}{WORDS}Tiny. {WORDS.strip()}"),
    (f"<article><p>in <b>bo</b>ld <a href='x>y'>link</a></p><p><a href=x>only a link here</a></p><div style='display: none'>no</div></article>",
     "in bold link only a link here"),
    (f"<main><table><tr><td>1</td><td>2</td></tr></table><pre>a\n  b</pre></main><nav><p>{WORDS}</p></nav>", "1 2 a b"),
    (f"<article><p>unclosed {WORDS}", f"unclosed {WORDS.strip()}"), ("<article><p>cut <a href='", "cut"),
    (f"<head><title>t</title><article><p>x</p></article>", "x"),
])
def test_layouts(tree, page, wanted):
    assert html_text.main_text(page, tree) == wanted


@pytest.mark.parametrize(("page", "wanted"), [
    *((f"<{tag}><article><p>One</p><p>Two {WORDS}</p></article>", f"One Two {WORDS.strip()}") for tag in ("svg", "object", "noscript", "math")),
    *((f"<article><p>One</p><{tag} width=1><p>Two</p><{tag}><b>no</b></{tag}><p>Three</p></article>", "One Two Three")
      for tag in ("svg", "object", "noscript")),
    ("<article><p>a<svg><svg><text>no</text></svg><text>no</text></svg>b</p><!-- <svg> --><p>c</p><svg>no</svg></article>", "ab c"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p></article>", "Let x=2 here"),
    ("<article><p>a</p><script>'<svg>'</script><object>no</object><p>b</p></article>", "a b"),
])
def test_elements_without_an_end(tree, page, wanted):
    assert html_text.main_text(page, tree) == wanted


def test_html_extra_columns(spark, tree):
    rows = spark.createDataFrame(
        [(1, "<article>a</article>", "old", 7), (1, "<article>a</article>", "old", 7), (None, None, None, None)],
        "page_id BIGINT, html STRING, text STRING, n_chars INT")
    found = html_text.extract(rows, tree=tree)
    assert found.columns == ["page_id", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "a", 1), (1, "a", 1), (None, "", 0)]
    assert html_text.extract(rows.limit(0), tree=tree).count() == 0


def test_many_tags_take_linear_time(tree):
    page = "<article>" + "<a href=\"" * 20_000 + "<div " * 20_000 + "<p>x" * 20_000
    assert html_text.main_text(page, tree)


def test_many_elements_without_an_end_take_linear_time(tree):
    assert html_text.main_text("<article>" + "<svg><object><noscript><p>x" * 20_000, tree)


def test_token_histogram(spark):
    held = open(tokens.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.splitlines())}
    encode = tiktoken.Encoding("t", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    lengths = [len(encode(t or "")) for (t,) in edges.given_rows(SF_DIR, "documents", "text")]
    found = QUERIES["op1_token_counts"](spark, SF_DIR).collect()
    assert {r.n_tokens: r.docs for r in found} == {n: lengths.count(n) for n in set(lengths)}
    for r in found:
        assert r.docs_upto == sum(x <= r.n_tokens for x in lengths) and r.docs_beyond == len(lengths) - r.docs_upto
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths) and r.tokens == r.docs * r.n_tokens
    histogram = tokens.suffix_sums(spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "n_tokens LONG, docs LONG"))
    got = {r.context: (r.tokens, r.docs_cut) for r in tokens.truncated_totals(histogram, [0, 100, 512, 10**6]).collect()}
    assert got == {c: (sum(min(x, c) for x in lengths), sum(x > c for x in lengths)) for c in (0, 100, 512, 10**6)}
    got = {r.share: r.n_tokens for r in tokens.quantiles(histogram, [0.1, 0.5, 1.0]).collect()}
    assert got == {q: sorted(lengths)[max(0, -(-int(q * 1000) * len(lengths) // 1000) - 1)] for q in (0.1, 0.5, 1.0)}


def test_token_edges(spark):
    found = tokens.length_histogram(edges.documents(spark)).collect()
    assert sum(r.docs for r in found) == len(edges.TEXTS) and found[0].n_tokens >= 0
    assert {r.n_tokens: r.docs for r in found}[0] == 3
    assert tokens.length_histogram(edges.empty(spark)).count() == 0


def test_packages_are_read_in_as_many_tasks(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").repartition(5)
    folder = fresh_folder(spark, "archives")
    written = archives.write_packages(pages, folder, package_bytes=2000)
    assert written.count() > 10
    found = archives.read_packages(written, folder)
    assert found.rdd.getNumPartitions() == written.count()
    assert sorted((r.page_id, r.payload) for r in found.collect()) == [(i, html) for i, _, html in rows]
