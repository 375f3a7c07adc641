import gzip
import hashlib
import zlib
from base64 import b32encode
from html.parser import HTMLParser
from pathlib import Path

from tidemark.llm import warc


def members(raw):
    """The gzip members of a file."""
    out = []
    while raw:
        one = zlib.decompressobj(31)
        out.append(one.decompress(raw))
        assert one.eof
        raw = one.unused_data
    return out


def standard_records(data):
    """Records by the standard's grammar: version line, named fields, empty line, block, two line ends, and nothing else."""
    out = []
    while data:
        version, _, data = data.partition(b"\r\n")
        assert version in (b"WARC/1.0", b"WARC/1.1"), version
        fields = {}
        while True:
            line, _, data = data.partition(b"\r\n")
            if not line:
                break
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        size = int(fields["Content-Length"])
        block, end, data = data[:size], data[size : size + 4], data[size + 4 :]
        assert len(block) == size and end == b"\r\n\r\n"
        assert fields["WARC-Type"] == "warcinfo" or fields["WARC-Block-Digest"] == "sha1:" + b32encode(hashlib.sha1(block).digest()).decode()
        out.append((fields, block))
    return out


class Plain(HTMLParser):
    """Text nodes outside of hidden elements, by the library's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out, self.links = 0, [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head", "template", "noscript")
        self.links += tag == "a" and any(k == "href" and v for k, v in attrs) and not self.hidden

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head", "template", "noscript")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_text_like_the_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        made = warc.derive(r.page_id, r.url, r.html)
        assert "".join(made["text"].split()) == "".join("".join(p.out).split())
        assert made["n_links"] == p.links


def test_records_link_and_carry_digests(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<html lang=fr><head><title>T &amp; u</title></head><p>x<b>y</b></p><p>z &lt;&#233;<a href='/q'>l</a>"), (2, None, None), (2, None, None), (None, "u", "<!-- x")], "page_id long, url string, html string")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 4
    one = next(r for r in rows if r.page_id == 1)
    assert one.text == "xy\nz <él" and one.title == "T & u" and one.language == "fr" and one.n_links == 1
    for r in rows:
        for record, name in ((r.metadata_record, r.metadata_id), (r.conversion_record, r.conversion_id)):
            head, block = record.split("\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
            raw = block.encode()[: int(fields["Content-Length"])]
            assert block.encode()[len(raw) :] == b"\r\n\r\n"
            assert fields["WARC-Refers-To"] == r.response_id and fields["WARC-Record-ID"] == name
            assert fields["WARC-Block-Digest"] == "sha1:" + b32encode(hashlib.sha1(raw).digest()).decode()
    path = tmp_path / "warc"
    warc.write_warc(pages, str(path))
    files = list(Path(path).iterdir())
    assert files and all(f.name.endswith(".warc.gz") for f in files)
    read = [standard_records(b"".join(members(f.read_bytes()))) for f in files]
    assert all([f[0][0]["WARC-Type"] for f in read]) and [f[0][0]["WARC-Type"] for f in read] == ["warcinfo"] * len(read)
    assert all(len(standard_records(m)) == 1 for f in files for m in members(f.read_bytes()))  # one member for each record
    assert sum(len(f) - 1 for f in read) == 8
    warc.write_warc(pages, str(tmp_path / "plain"), compress=False)
    plain = [standard_records(f.read_bytes()) for f in (tmp_path / "plain").glob("part-*")]
    assert all(f[0][0]["WARC-Type"] == "warcinfo" for f in plain)
    key = lambda files: sorted((h["WARC-Record-ID"], b) for f in files for h, b in f[1:])
    assert key(plain) == key(read)
    assert warc.derivatives(pages.limit(0)).collect() == []


def test_unclosed_head_ends_where_the_body_begins():
    body = "<p>Whole article text</p><script>var x = '</head>';</script><a href='/q'>l</a>"
    for start in ("<!DOCTYPE html><html><head><title>t</title>", "<html><HEAD ><meta charset=utf-8>\n<!-- <body> --><title>t</title><style>p > a {}</style>", "<head><script>'<body><p>'</script><title>t</title><link rel=x>", "<head><title>t</title><noscript><p>n</p></noscript>"):
        for middle in ("<body>", "<body class=a>", "", "</head><body>", "</head>", "</html>"):
            made = warc.derive(1, "u", start + middle + body)
            assert (made["text"], made["title"], made["n_links"]) == ("Whole article text\nl", "t", 1), start + middle
    assert warc.plain_text("<head><title>t</title>bare text") == "bare text"
    assert warc.plain_text("<head><title>t <p> </title><meta name=a></head>x") == "x"
    assert warc.plain_text("<head>odd <b>text</b><title>t</title></head>x") == "x"
    assert warc.plain_text("<header>x</header>") == "x" and warc.plain_text("<head><title>t") == ""
    assert warc.plain_text("<head>x<title>" * 50_000).split() == ["x"] * 50_000


def test_quoted_attributes():
    for page, text in (
        ('<p title="a>b">x</p>', "x"), ('<a href="/q?x=1>2">l</a>', "l"), ("<p title='\">'>x", "x"), ("<p a=b>x", "x"), ("<p don't>x", "x"), ('<p a="b>x', "x"),
        ('<img alt="a > b" src=x>y', "y"), ('<script data-x="</p>">no</script>z', "z"), ("a < b > c", "a < b > c"), ('<p a = "x>y" b>z', "z"),
    ):
        assert warc.plain_text(page) == text, page
    made = warc.derive(1, "u", '<a title="x>y" href="/q?x=1>2">l</a><a name="href=/no">m</a>')
    assert made["n_links"] == 1 and "outlink: /q?x=1>2 L" in made["metadata_record"]
    assert warc.plain_text('<p a="' * 20_000 + "x") is not None


def response(name, body, head="HTTP/1.1 200 OK\r\nServer: s/1\r\nContent-Type: text/html; charset=utf-8", kind="response"):
    block = head.encode() + b"\r\n\r\n" + body
    return (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2020-02-0{len(name) % 9 + 1}T03:04:05Z\r\nwarc-target-uri: http://h/{name}\r\n"
        f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}\r\nWARC-Payload-Digest: sha1:P{name}\r\nContent-Length: {len(block)}\r\n\r\n"
    ).encode() + block + b"\r\n\r\n"


def test_responses_of_warc_files(spark, tmp_path):
    page = "<html lang=de><head><title>T</title></head><p>gr\u00fc\u00dfe</p>".encode()
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (page[:7], page[7:])) + b"0\r\n\r\n"
    kind = "\r\nContent-Type: text/html; charset="
    parts = [
        response("info", b"x: y", kind="warcinfo"), response("a", page), response("req", b"", "GET / HTTP/1.1", "request"),
        response("bb", chunks, f"HTTP/1.1 200 OK{kind}utf-8\r\nTransfer-Encoding: chunked"), response("ccc", gzip.compress(page), f"HTTP/1.1 200 OK{kind}UTF-8\r\nContent-Encoding: gzip"),
        response("dddd", page.decode().encode("latin-1"), f"HTTP/1.1 404 Not Found{kind}iso-8859-1"), response("eeeee", b"not gzip", f"HTTP/1.1 200 OK{kind}nonsense\r\nContent-Encoding: gzip"), response("ffffff", b""),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.warc").write_bytes(b"".join(parts[:4]))
    (folder / "two.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[4:]) + gzip.compress(parts[1])[:40])  # cut off
    found = warc.read_warc(spark, str(folder))
    rows = {r.response_id: r for r in warc.derivatives(found).collect()}
    assert set(rows) == {f"<urn:uuid:{x}>" for x in ("a", "bb", "ccc", "dddd", "eeeee", "ffffff")}
    for name, r in rows.items():
        name = name[10:-1]
        meta = standard_records(r.metadata_record.encode())[0]
        text = standard_records(r.conversion_record.encode())[0]
        for fields, _ in (meta, text):
            assert fields["WARC-Refers-To"] == f"<urn:uuid:{name}>" and fields["WARC-Refers-To-Target-URI"] == f"http://h/{name}"
            assert fields["WARC-Refers-To-Date"] == fields["WARC-Date"] == f"2020-02-0{len(name) % 9 + 1}T03:04:05Z"
        told = meta[1].decode().split("\r\n")
        assert f"sourcePayloadDigest: sha1:P{name}" in told and text[0]["WARC-Source-Payload-Digest"] == f"sha1:P{name}"
        if name in ("a", "bb", "ccc", "dddd"):
            assert (r.text, r.title, r.language) == ("gr\u00fc\u00dfe", "T", "de")
    assert "sourceHeader: Server: s/1" in rows["<urn:uuid:a>"].metadata_record and "sourceStatus: HTTP/1.1 404 Not Found" in rows["<urn:uuid:dddd>"].metadata_record
    assert rows["<urn:uuid:eeeee>"].text == "not gzip" and rows["<urn:uuid:ffffff>"].text == ""
    out = tmp_path / "out"
    warc.write_warc(found, str(out))
    refers = [h.get("WARC-Refers-To") for f in out.iterdir() for h, _ in standard_records(b"".join(members(f.read_bytes())))[1:]]
    assert sorted(refers) == sorted(2 * list(rows))


def test_other_columns_and_long_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>" * 300_000, "d", "t", 3)], "page_id long, url string, html string, date string, text string, n_links int")
    r = warc.derivatives(df).first()
    assert r.text_bytes == 2 * 300_000 - 1 and r.n_links == 0
