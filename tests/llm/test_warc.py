import hashlib
import json
from html.parser import HTMLParser

from lodeframe.llm.warc import BLOCKS, CELLS, derivative_digests, derive, digest, export_warc, parse_html, read_warc, responses, write_warc


class Plain(HTMLParser):
    """The same rules by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.quiet, self.title = [], [], None, None

    def handle_starttag(self, tag, attrs):
        if self.quiet:
            return
        if tag in ("script", "style", "template", "noscript", "title"):
            self.quiet, self.held = tag, []
        elif tag in BLOCKS:
            self.out.append("\n")
        elif tag in CELLS:
            self.out.append(" ")
        elif tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if self.quiet:
            if tag == self.quiet:
                if tag == "title" and self.title is None:
                    self.title = " ".join("".join(self.held).split())
                self.quiet = None
        elif tag in BLOCKS:
            self.out.append("\n")
        elif tag in CELLS:
            self.out.append(" ")

    def handle_data(self, data):
        (self.held if self.quiet else self.out).append(data if self.quiet else data.replace("\n", " "))


def brute(html):
    p = Plain()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x), p.title or "", p.links


def test_whole_table_matches_the_standard_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    out = derivative_digests(pages).collect()
    assert {r.page_id for r in out} == set(rows) and len({r.conversion_id for r in out} | {r.metadata_id for r in out} | {r.response_id for r in out}) == 3 * len(rows)
    for r in out:
        text, title, links = brute(rows[r.page_id].html)
        assert (r.n_chars, r.title, r.n_links) == (len(text), title, len(links))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.conversion_digest == digest(text.encode())
        assert r.metadata_refers_to == r.conversion_refers_to == r.response_id and r.payload_digest == r.source_digest == digest(rows[r.page_id].html.encode())


def test_odd_markup():
    assert parse_html("a<b>c</b>d<p>e<br/>f<!-- x <p> --><td>g</td>&lt;h&amp;") == ("acd\ne\nf g <h&", "", [])
    assert parse_html("<script>'</p>' < 3</script>x<style>y") == ("x", "", [])
    assert parse_html("1 < 2 <a href='x&amp;y' title='>'>z</a><a href=q>w") == ("1 < 2 zw", "", ["x&y", "q"])
    assert parse_html("<!-- never closed <p>text") == ("", "", [])
    assert parse_html("<title> A\n&amp; B </title><p x=\"unclosed>t")[1] == "A & B"
    assert parse_html('<a "' * 20_000)[0] == "" and parse_html("<" * 100_000)[0] == "<" * 100_000


def test_files_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<title>T</title><p>é one"), (2, None, None), (2, None, None), (None, "http://b/\r\nX: y", ""), (4, "u", "<p>" + "long " * 60_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, headers string")
    records = responses(pages)
    both = records.drop("page").unionByName(derive(records))
    write_warc(both, f"{tmp_path}/table")
    (tmp_path / "files").mkdir()
    assert export_warc(spark, f"{tmp_path}/table", f"{tmp_path}/files/all.warc.gz") == 15
    back = read_warc(spark, f"{tmp_path}/files/*.warc.gz")
    key = lambda r: (r.warc_type, r.record_id, r.refers_to, r.block_digest, r.payload_digest, bytes(r.block))
    assert sorted(map(key, back.collect()), key=repr) == sorted(map(key, both.collect()), key=repr)
    again = derive(back)
    assert sorted(r.block_digest for r in again.collect()) == sorted(r.block_digest for r in derive(records).collect())
    meta = [json.loads(bytes(r.block)) for r in back.where("warc_type = 'metadata'").collect()]
    one = next(m for m in meta if m["title"] == "T")
    assert one["http-status"] == 200 and one["warc-header"]["WARC-Type"] == "response" and one["http-headers"]["content-type"].startswith("text/html")
    assert derive(records.limit(0)).count() == 0 and derivative_digests(pages.limit(0)).count() == 0
