import base64
import gzip
import hashlib
import json
import re
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest

from worktrail.llm import warc
from worktrail.llm.warc import derivatives, responses, visible_text, write_warc

DATE = "2024-01-01T00:00:00Z"


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Reader(HTMLParser):
    """Text by the standard parser, for pages that are well formed."""

    def __init__(self):
        super().__init__()
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def test_pages_yield_linked_records(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r for r in responses(pages, DATE).collect()}
    rows = derivatives(responses(pages, DATE)).collect()
    given = {r.page_id: r for r in pages.collect()}
    assert len(rows) == 2 * len(given) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        s, p = source[r.page_id], given[r.page_id]
        raw = r.block.encode()
        assert (r.refers_to, r.target_uri, r.date) == (s.record_id, p.url, DATE)
        assert r.source_block_digest == sha(bytes(s.block)) and r.source_payload_digest == sha(p.html.encode())
        assert r.block_digest == sha(raw) and r.content_length == len(raw)
        if r.warc_type == "conversion":
            reader = Reader()
            reader.feed(p.html)
            reader.close()
            assert re.sub(r"\s", "", r.block) == re.sub(r"\s", "", "".join(reader.out))
        else:
            told = json.loads(r.block)
            assert told["http-status"] == "HTTP/1.1 200 OK" and told["digests-agree"] and told["payload-length"] == len(p.html.encode())
            assert told["links"] and ["Content-Type", "text/html; charset=utf-8"] in told["http-headers"]


def test_text_of_odd_markup():
    page = "<p>a<b>b</b> c&amp;d<br>e<script>if (a<b) '</p>'</script>f<!-- x <p> --><a title='>' href=x>g</a><STYLE>h</style>\n i < 3 &#233;&nbsp;k"
    assert visible_text(page) == "ab c&d\ne fg i < 3 é k"
    assert visible_text("") == visible_text("<p></p>") == visible_text("<script>never closed") == ""
    assert visible_text("x" * 100000) == "x" * 100000


def test_edge_cases(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x", "m"), (1, "u", "<p>x", "m"), (2, None, None, "m"), (None, "v", "", "m")], "page_id long, url string, html string, date string")
    rows = derivatives(responses(pages, DATE)).collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    assert [r.block for r in rows if r.page_id == 1 and r.warc_type == "conversion"] == ["x", "x"]
    assert derivatives(responses(pages.limit(0), DATE)).count() == 0
    given = spark.createDataFrame(
        [("<a>", "t", None, bytearray(b"HTTP/1.0 404 Gone\r\nX: y\r\n\r\n<title>caf\xe9</title><meta charset=latin-1>"), "sha1:OLD", None, 7, "k"), ("<b>", None, None, None, None, None, 8, None), (None, "t", None, bytearray(b"x"), None, None, 9, None)],
        "record_id string, target_uri string, date string, block binary, block_digest string, payload_digest string, extra int, warc_type string",
    )
    got = {(r.extra, r.warc_type): r for r in derivatives(given).collect()}
    assert set(got) == {(7, "metadata"), (7, "conversion"), (8, "metadata"), (8, "conversion")}
    told = json.loads(got[7, "metadata"].block)
    assert told["title"] == "café" and not told["digests-agree"] and told["http-headers"] == [["X", "y"]] and got[7, "metadata"].source_block_digest == "sha1:OLD"
    assert got[8, "conversion"].block == "" and got[8, "conversion"].source_payload_digest == sha(b"")


def test_written_files_parse_back(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20)
    derived = derivatives(responses(pages, DATE))
    write_warc(derived, str(tmp_path / "out"))
    found = {}
    for file in Path(tmp_path / "out").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            size = int(fields["Content-Length"])
            assert version == "WARC/1.1" and rest[size : size + 4] == b"\r\n\r\n" and sha(rest[:size]) == fields["WARC-Block-Digest"]
            found[fields["WARC-Record-ID"]] = rest[:size].decode(), fields["WARC-Refers-To"]
            data = rest[size + 4 :]
    assert found == {r.record_id: (r.block, r.refers_to) for r in derived.collect()}


@pytest.mark.parametrize("bit", ["<a ", "<a href=", "<a \"", "<a '", "<!", "<!--", "<script ", "</script", "<title ", "&#9", "<", ">", "<a b='\">", "<?x "])
def test_long_pages_without_an_end(bit):
    """A megabyte of tags that are never closed takes time in proportion to its length."""
    block = b"HTTP/1.1 200 OK\r\n\r\n" + (bit * (1_000_000 // len(bit))).encode()
    start = time.time()
    assert len(warc.derive_one("r", None, None, block, None, None)) == 2
    assert time.time() - start < 20
    assert warc.visible_text("x &#" + "9" * 9000 + "; y") == "x \ufffd y"


@pytest.mark.parametrize("charset", ["undefined", "idna", "hex", "rot13", "punycode", "utf-7", "unicode_escape", "no-such"])
def test_odd_character_sets_of_pages(charset):
    page = f"<meta charset={charset}><p>caf\u00e9 \\ud800 +2AA-".encode() + b"\xff\xfe"
    for head in ("Content-Type: text/html", f"Content-Type: text/html; charset={charset}"):
        assert len(warc.derive_one("r", None, None, f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + page, None, None)) == 2
