import base64
import gzip
import hashlib
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from plenara.llm import warc
from plenara.llm.common import table


class Reader(HTMLParser):
    """The words of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.words.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.words.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


PAGE = """<!DOCTYPE html><HTML lang="DE"><head><title>A &amp; <b>B</b></title><style>p{}</style><script>var t="</p><a href='/no'>";</script ></head>
<body><!-- <a href="/hidden"> --><p title="a>b">One<br/>two &lt;3&gt;<div>x<span> y</span>  z &eacute;</div><a class=q href="/to?x=1&amp;y=2">in</a> 1 < 2 <a href='http://[bad'>out</a></body></html>"""


def header(record):
    lines = record.headers.split("\r\n")
    assert lines[0] == "WARC/1.1" and lines[-1] == ""
    return dict(x.split(": ", 1) for x in lines[1:-1])


def test_records_refer_to_their_response(spark):
    rows = [("<urn:uuid:1>", "http://h.example/d/p", "2020-01-02T03:04:05Z", "HTTP/1.1 200 OK\r\nServer: s\r\nX-Y:  z ", PAGE, "x", 1), (None, None, None, None, None, "x", 2), (None, None, None, None, None, "x", 3)]
    got = warc.derivatives(spark.createDataFrame(rows, "response_id string, target_uri string, date string, http string, payload string, block string, n int")).collect()
    assert len(got) == 6
    meta, text = (next(r for r in got if r.n == 1 and r.record_type == k) for k in ("metadata", "conversion"))
    for r in (meta, text):
        h = header(r)
        assert h["WARC-Refers-To"] == "<urn:uuid:1>" and h["WARC-Record-ID"] == r.record_id and h["WARC-Date"] == "2020-01-02T03:04:05Z"
        assert int(h["Content-Length"]) == len(r.block)
        assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode()
        assert h["X-Refers-To-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    assert text.block.decode().split("\n") == ["A & B", "One", "two <3>", "x y z é", "in 1 < 2 out"]
    fields = meta.block.decode().split("\r\n")
    assert [x.split(": ")[0] for x in fields[:2]] == ["refers-to-payload-digest", "refers-to-block-digest"]
    assert fields[2:] == [
        "http-status: HTTP/1.1 200 OK", "http-server: s", "http-x-y: z", "title: A & B", "language: de", "outlink: http://h.example/to?x=1&y=2 A/@href", "outlink: http://[bad A/@href", "",
    ]
    empty = [r for r in got if r.n > 1]
    assert len({r.record_id for r in empty}) == 2 and all(not r.block for r in empty if r.record_type == "conversion")
    assert all(header(r)["WARC-Date"] == warc.NO_DATE for r in empty) and meta.record_id not in {r.record_id for r in empty}
    assert gzip.decompress(warc.as_file_part(text.headers, bytes(text.block))).endswith(b"out\r\n\r\n")


def test_text_equals_a_full_parser(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages").select("html").collect()
    for (page,) in pages:
        reader = Reader()
        reader.feed(page)
        assert "".join("".join(reader.words).split()) == "".join(warc.text_of(page).split())


def test_odd_pages_take_linear_time():
    for bad in ("<!--" * 200_000, "<script>" * 100_000, '<a href="' * 100_000, "<p " * 200_000, "&" * 500_000, "<" * 500_000, "x" * 1_000_000):
        warc.text_of(bad)
        warc.fields_of(bad, "http://h.example/", "", ("", ""))


def test_empty_table(spark, tmp_path):
    table(spark, "/root/testdata/sf0.001", "pages").where(F.lit(False)).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op4_warc_derivatives(spark, str(tmp_path)).count() == 0


def record(kind, named, block):
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *named, ("Content-Length", len(block))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def test_responses_are_read_from_files(spark, tmp_path):
    page = "<p>gr\u00fcn</p>".encode("latin-1")
    chunked = b"5\r\n" + page[:5] + b"\r\n" + f"{len(page) - 5:x};x=y\r\n".encode() + page[5:] + b"\r\n0\r\n\r\n"
    one = record("response", [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://h.example/"), ("WARC-Date", "2021-02-03T04:05:06Z"), ("WARC-Payload-Digest", "sha1:ABC"), ("WARC-Block-Digest", "sha1:DEF")],
                 b"HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nX-Source: kept\r\n\r\n" + chunked)
    two = record("response", [("WARC-Record-ID", "<urn:uuid:2>")], b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress("<p>\u00e9".encode()))
    info = record("warcinfo", [], b"software: x")
    (tmp_path / "a.warc").write_bytes(info + one + two + one[:60])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(one) + gzip.compress(two)[:100])
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.path[-4:], r.response_id) for r in got) == [("c.gz", "<urn:uuid:1>"), ("warc", "<urn:uuid:1>"), ("warc", "<urn:uuid:2>")]
    first = next(r for r in got if r.response_id == "<urn:uuid:1>")
    assert first.payload == "<p>gr\u00fcn</p>" and next(r for r in got if r.response_id == "<urn:uuid:2>").payload == "<p>\u00e9"
    out = [r for r in warc.derivatives(warc.read_warc(spark, str(tmp_path))).collect() if r.response_id == "<urn:uuid:1>" and r.path.endswith("a.warc")]
    for r in out:
        h = header(r)
        assert (h["WARC-Refers-To"], h["WARC-Refers-To-Date"], h["X-Refers-To-Payload-Digest"], h["X-Refers-To-Block-Digest"]) == ("<urn:uuid:1>", "2021-02-03T04:05:06Z", "sha1:ABC", "sha1:DEF")
    meta = next(r for r in out if r.record_type == "metadata").block.decode()
    assert "http-x-source: kept\r\n" in meta and "refers-to-payload-digest: sha1:ABC\r\n" in meta


class Links(HTMLParser):
    """Title, language and links of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.title, self.lang, self.links, self.inside = [], None, [], False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        self.inside = tag == "title"
        if tag == "html" and named.get("lang"):
            self.lang = named["lang"].lower()
        if tag == "a" and named.get("href") is not None:
            self.links.append(named["href"].strip())

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)


def test_records_of_all_pages_equal_brute_force(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {(r.page_id, r.record_type): r for r in warc.derivatives(warc.read_responses(warc.response_records(pages))).collect()}
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    rows = pages.collect()
    assert len(got) == 2 * len(rows)
    for r in rows:
        payload = r.html.encode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
        reader = Links()
        reader.feed(r.html)
        want = {"refers-to-payload-digest": sha1(payload), "refers-to-block-digest": sha1(http.encode() + b"\r\n\r\n" + payload), "http-status": "HTTP/1.1 200 OK"}
        want |= {"http-content-type": "text/html; charset=utf-8", "http-content-length": str(len(payload))}
        want |= {"title": " ".join("".join(reader.title).split())} if "<title" in r.html else {}
        want |= {"language": reader.lang} if reader.lang else {}
        meta, text = got[r.page_id, "metadata"], got[r.page_id, "conversion"]
        lines = [x.split(": ", 1) for x in meta.block.decode().split("\r\n")[:-1]]
        assert {k: v for k, v in lines if k != "outlink"} == want
        assert [v.removesuffix(" A/@href") for k, v in lines if k == "outlink"] == [" ".join(urljoin(r.url, x).split()) for x in reader.links]
        assert meta.response_id == text.response_id == header(text)["WARC-Refers-To"] and len({meta.record_id, text.record_id, meta.response_id}) == 3
        for d in (meta, text):
            h = header(d)
            assert (h["WARC-Type"], h["WARC-Target-URI"], h["WARC-Block-Digest"], h["Content-Length"]) == (d.record_type, r.url, sha1(bytes(d.block)), str(len(d.block)))
            assert d.refers_to_digest == sha1(payload) == h["X-Refers-To-Payload-Digest"]
