import hashlib
import html
import os
import random
import re
import zlib
from collections import Counter

import pytest

from lodegrid.llm import html_text, mpeg_audio
from tests.llm.conftest import SF


def test_store_and_read_back():
    for data in (b"", b"a" * 576, b"a" * 577, os.urandom(30_000), b"\xff\xfb\x90\x00" * 2000, b"\xff" * 3000):
        media = mpeg_audio.store(data)
        seen = mpeg_audio.inspect(media)
        got = mpeg_audio.payload(media, seen)
        assert got[: len(data)] == data and len(got) % 576 == 0 and set(got[len(data) :]) <= {255}
        assert seen["right"] == seen["checked"] == len(seen["offsets"]) + 1 and seen["skipped"] == 0
        assert mpeg_audio.unpadded(seen) == len(data) and seen["samples"] == 1152 * len(got) // 576
        assert seen["table"]["frames"] == len(seen["offsets"]) and seen["id3v1"]


def test_damage():
    rng = random.Random(7)
    media = mpeg_audio.store(b"hello" * 1000)
    seen = mpeg_audio.inspect(media)
    at = seen["offsets"][3]
    again = mpeg_audio.inspect(media[:at] + rng.randbytes(333) + media[at:])
    assert again["skipped"] == 333 and len(again["offsets"]) == len(seen["offsets"])
    broken = bytearray(media)
    broken[seen["offsets"][2] + 10] ^= 1
    assert mpeg_audio.inspect(bytes(broken))["right"] == seen["right"] - 1
    for _ in range(100):
        mpeg_audio.inspect(rng.randbytes(rng.randint(0, 3000)))


def test_headers():
    h = mpeg_audio.header(b"\xff\xfb\x90\x00")
    assert (h.layer, h.rate, h.kbits, h.size, h.samples, h.checked) == (3, 44100, 128, 417, 1152, False)
    assert mpeg_audio.header(b"\xff\xff\xff\xff") is None and mpeg_audio.header(b"\xff\xfb\x00\x00") is None
    v2 = mpeg_audio.header(b"\xff\xf3\x80\xc0")
    assert (v2.rate, v2.kbits, v2.size, v2.samples, v2.side) == (22050, 64, 208, 576, 9)


def test_media_columns(edge_docs, no_docs):
    rows = edge_docs.collect()
    got = mpeg_audio.digest(mpeg_audio.text_to_media(edge_docs).select("doc_id", "media")).collect()
    want = []
    for r in rows:
        data = (r.text or "").encode()
        p = data.ljust(max(576, -(-len(data) // 576) * 576), b"\xff")
        want.append((r.doc_id, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, mpeg_audio.text_digest(edge_docs).collect()))) == sorted(map(str, map(tuple, got)))
    assert mpeg_audio.digest(mpeg_audio.text_to_media(no_docs).select("doc_id", "media")).count() == 0
    full = mpeg_audio.with_audio(mpeg_audio.text_to_media(edge_docs, out_col="kept"), media_col="kept", out_col="n_words")
    assert full.select("n_words.frames").where("frames >= 1").count() == 13


def frames(head, bits, n=4, size=None):
    """A stream of equal frames whose checksum covers the header's end and ``bits`` bits of ``body``, bit by bit."""
    h = mpeg_audio.header(head)
    body = bytes(random.Random(bits).randrange(256) for _ in range(h.size - 6))
    covered = "".join(f"{b:08b}" for b in head[2:4] + body)[: 16 + bits]
    crc = 0xFFFF
    for bit in covered:
        crc = (crc << 1 ^ (0x8005 if crc >> 15 != int(bit) else 0)) & 0xFFFF
    return (head + crc.to_bytes(2, "big") + body) * n, h


def test_checksums_of_all_layers():
    # layer I: 4 bits for each of 32 subbands and channel, once from the bound on in joint stereo
    for mode, bits in ((0x00, 256), (0xC0, 128), (0x40, 4 * (4 * 2 + 28)), (0x70, 4 * (16 * 2 + 16))):
        data, h = frames(bytes([0xFF, 0xFE, 0xC0, mode]), bits)
        seen = mpeg_audio.inspect(data)
        assert h.layer == 1 and seen["checked"] == seen["right"] == len(seen["offsets"]) == 4, mode
        data = bytearray(data)
        data[8] ^= 1
        assert mpeg_audio.inspect(bytes(data))["right"] == 3
    # layer II at 64 kbit/s and 48 kHz, mono: table a, 27 subbands, two more bits for each that has an allocation
    head = bytes([0xFF, 0xFC, 0x44, 0xC0])
    h = mpeg_audio.header(head)
    body = bytes(random.Random(9).randrange(256) for _ in range(h.size - 6))
    flat, at, selected = "".join(f"{b:08b}" for b in body), 0, 0
    for n, bits in ((11, 4), (12, 3), (4, 2)):
        for _ in range(n):
            selected += "1" in flat[at : at + bits]
            at += bits
    assert h.layer == 2 and mpeg_audio.protected(head + b"xx" + body, h) == at + 2 * selected == 88 + 2 * selected
    crc = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in head[2:]) + flat[: at + 2 * selected]:
        crc = (crc << 1 ^ (0x8005 if crc >> 15 != int(bit) else 0)) & 0xFFFF
    seen = mpeg_audio.inspect((head + crc.to_bytes(2, "big") + body) * 3)
    assert seen["checked"] == seen["right"] == 3


def test_tags():
    media = mpeg_audio.store(b"abc")
    sound = media[media.index(b"\xff\xfa") : -128]
    size = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    old = b"TT2\x00\x00\x03\x00hi"
    frame3 = b"TIT2" + (3).to_bytes(4, "big") + b"\0\0\0hi"
    frame4 = b"TIT2" + size(3) + b"\0\0\0hi"
    more3 = (6).to_bytes(4, "big") + bytes(6)
    more4 = size(6) + b"\1\0"
    for tag, name in (
        (b"ID3\x02\0\0" + size(len(old)) + old, "TT2"),
        (b"ID3\x03\0\x40" + size(len(more3 + frame3)) + more3 + frame3, "TIT2"),
        (b"ID3\x04\0\x50" + size(len(more4 + frame4)) + more4 + frame4 + b"3DI\x04\0\x50" + size(len(more4 + frame4)), "TIT2"),
    ):
        seen = mpeg_audio.inspect(tag + sound)
        assert seen["tags"][name] == b"\0hi" and seen["skipped"] == 0 and len(seen["offsets"]) == 1, tag
    item = (2).to_bytes(4, "little") + bytes(4) + b"Title\0hi"
    count = lambda flags: b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + flags.to_bytes(4, "little") + bytes(8)
    for tag in (item + count(0), count(0xA0000000) + item + count(0x80000000)):
        for end in (b"", b"TAG".ljust(128, b"\0")):
            seen = mpeg_audio.inspect(sound + tag + end)
            assert seen["ape"] == {"Title": b"hi"} and seen["skipped"] == 0 and seen["id3v1"] == bool(end)


PAGE = """<html><body><header class="site-header"><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use cookies</div>
<div id="main"><div class="sidebar"><p>Side words here</p></div><article class="post post-{i}"><header><h1>Title &amp; more</h1></header>
<p>First para &lt;b&gt; text. <a href=x>link</a> more  text that is long enough to count for something {i}.</p><ul><li>one<li>two</ul>
<div class="ad">Buy</div><form><p>subscribe</p></form><section class="comments"><p>Nice post!</p></section></article></div><footer>f</footer></body></html>"""


def test_extraction():
    html = PAGE.format(i=7)
    path = html_text.best_path(html)
    assert path.endswith("div/article.post.post-#")
    want = "Title & more\nFirst para <b> text. link more text that is long enough to count for something 7.\none\ntwo"
    assert html_text.extract(html, path) == want
    for odd in (None, "", "<", "<a", "a<b>c", "<p " * 1000, "<div>" * 30_000 + "x", "<script>x", "&#0;&#x110000;&amp", "<!-- x", "<b>" * 9000 + "</b>" * 9000):
        html_text.extract(odd, html_text.best_path(odd))
    assert html_text.extract("a<b>c & d", None) == "ac & d" and html_text.extract(None, None) == ""


def test_consensus(spark):
    # a short page of a host takes the host's container, though its own advert is longer
    short = '<body><div class="promo-box"><p>' + "buy now words " * 30 + '</p></div><div class="content-7"><p>tiny</p></div></body>'
    long = '<body><div class="promo-box"><p>buy</p></div><div class="content-{}"><p>' + "real words of the article " * 30 + "</p></div></body>"
    rows = [(i, f"http://h.example/{i}", long.format(i), "x") for i in range(5)] + [(9, "http://H.example:80/z", short, "x"), (10, None, None, None), (11, "bad url", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got[9] == "tiny" and got[0].startswith("real words") and got[10] == got[11] == ""
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_wrappers_and_forms_are_judged_by_content():
    body = "<h1>Title</h1><p>" + "real words of the article " * 20 + "</p>"
    want = "Title\n" + ("real words of the article " * 20).strip()
    for open_, close in (('<div id="content-sidebar-wrap">', "</div>"), ('<div class="layout has-sidebar">', "</div>"), ('<div class="main menu-left">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<form id="form"><fieldset>', "</fieldset></form>")):
        for inner in (f"<article>{body}</article>", f'<div class="story-text">{body}</div>', body):
            page = f'<body><nav><a href=x>menu</a></nav>{open_}{inner}<div class="sidebar"><p>Side words</p></div>{close}<div class="cookie-notice">We use cookies</div><footer>f</footer></body>'
            assert html_text.extract(page, html_text.best_path(page)) == want, (open_, inner)
    # long comments, a search form and small boxes still go
    comments = '<div class="comments-area"><ol><li class="comment"><article>' + "what a reader thinks " * 60 + "</article></li></ol></div>"
    page = f'<body><form action=s><p>Search here</p></form><article>{body}<div class="share-box"><div>Share this</div></div></article>{comments}</body>'
    assert html_text.extract(page, html_text.best_path(page)) == want
    assert html_text.extract('<body><div class="cookie-notice">We use cookies</div></body>', None) == ""


def test_whole_article_around_the_best_container():
    long = ("real words of the article " * 30).strip()
    got = lambda inner: html_text.extract(page := f"<body><nav><a href=x>menu</a></nav>{inner}<footer>f</footer></body>", html_text.best_path(page))
    assert got(f"<article><h1>Title</h1><p>lede</p><section><p>{long}</p></section><section class=b><p>more</p></section></article>") == f"Title\nlede\n{long}\nmore"
    assert got(f'<article><header><h1>Title</h1></header><div class="entry-content"><p>{long}</p></div></article>') == f"Title\n{long}"
    assert got(f'<main><article><header><div><h1>Title</h1></div></header><div><div class="entry-content"><p>{long}</p></div></div></article></main>') == f"Title\n{long}"
    assert got(f'<div class="post"><h1>Title</h1><div class="wrap"><div class="a"><p>{long}</p></div></div><div class="b"><p>more</p></div></div>') == f"Title\n{long}\nmore"
    assert got(f'<h1>Title</h1><p>lede</p><div class="text"><p>{long}</p></div>') == f"Title\nlede\n{long}"
    assert got(f'<div class="related-links"><div><a href=x>other story</a></div></div><div class="text"><p>{long}</p></div>') == long


def plain_text(page):
    """The article of a page of the test tables by patterns alone: cut at block tags, other tags out."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    if not inside:
        return ""
    inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inside[1], flags=re.S)
    inner = re.sub(r"<br[^>]*>", " ", inner)
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|pre|table|tr|td|th|section|figure|figcaption|dl|dt|dd|hr)\b[^>]*>", inner)
    parts = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", x)).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_whole_table_against_plain_loops(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.collect()
    votes: dict[str, Counter] = {}
    for r in rows:
        if (path := html_text.best_path(r.html)) is not None:
            votes.setdefault(html_text.host(r.url), Counter())[path] += 1
    won = {h: min(c, key=lambda p: (-c[p], p)) for h, c in votes.items()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.query(spark, SF).collect()}
    hits = words = found = 0
    for r in rows:
        text = html_text.extract(r.html, won.get(html_text.host(r.url)))
        assert got[r.page_id] == (text, len(text))
        want = Counter(plain_text(r.html).split())
        hits, words, found = hits + (want & Counter(text.split())).total(), words + want.total(), found + len(text.split())
    assert len(got) == len(rows) and 2 * hits / (words + found) > 0.999, "F1 of words"


def test_two_containers_compete_for_a_host(spark):
    body = "<p>" + "real words of the article " * 30 + "</p>"
    old, new = '<body><div class="left">{}</div></body>', '<body><div class="wide"><div class="story">{}</div></div></body>'
    rows = [(i, "http://h.example/", old.format(body)) for i in range(3)] + [(10 + i, "http://h.example/", new.format(body)) for i in range(2)]
    rows += [(20, "http://h.example/", '<body><div class="promo">' + "<p>buy it now at once</p>" * 40 + '</div><div class="left"><p>short</p></div></body>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {r.host: (r.path, r.votes) for r in html_text.host_paths(pages).collect()}
    assert paths["h.example"] == ("#root/body/div.left", 3)
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got[20] == "short" and got[10] == got[11] == got[0] != "", "pages off the winning path keep their own best container"


def test_column_names(spark):
    page = PAGE.format(i=1)
    rows = [(1, "http://a.example/", page, "u", 1, "x", "y"), (1, "http://a.example/", page, "u", 1, "x", "y"), (2, None, None, None, None, None, None), (3, "", "<p>" + "very long words " * 200_000, "", 0, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, Link string, Body string, _host string, _path_of_host long, _host_of_path string, text string")
    out = html_text.main_text(pages, url_col="Link", html_col="Body")
    assert out.columns == ["page_id", "Link", "Body", "_host", "_path_of_host", "_host_of_path", "text"]
    got = sorted((r.page_id, r._host, len(r.text)) for r in out.where("page_id != 2").collect())
    want = len(html_text.extract(page, html_text.best_path(page)))
    assert got == [(1, "u", want), (1, "u", want), (3, "", 16 * 200_000 - 1)]
    for name in ("link", "BODY"):
        with pytest.raises(ValueError):
            html_text.main_text(pages, url_col="Link", html_col="Body", out_col=name)
