"""Media round trips, perspective rotation and HTML layout."""

import hashlib
import html
import random
import re
import struct
import tarfile
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat, html_text, media

TEXTS = [(1, "hello"), (2, None), (3, ""), (4, "é" * 40), (5, "hello"), (5, "hello"), (None, "x" * 64), (7, "long " * 60_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, 2) for i, t in rows], "doc_id long, text string, folder string, offset int, width int").repartition(2)


def test_png_is_a_real_png_and_lossless():
    for raw in (b"", b"abc", bytes(range(256)) * 3):
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        png = media.to_png(payload)
        assert media.from_png(png) == payload and media.png_header(png[:33]) == (64, len(payload) // 64, 8)
        assert struct.unpack(">I", png[29:33])[0] == zlib.crc32(png[12:29])
        with pytest.raises(ValueError):
            media.from_png(png[:50] + bytes([png[50] ^ 1]) + png[51:])


@pytest.mark.parametrize("scheme", ["file://", ""])
def test_store_and_read_back(spark, tmp_path, scheme):
    """With and without a scheme, which then is that of Spark's own file system."""
    rows, places = media.store(docs(spark, TEXTS), scheme + str(tmp_path / "shards"))
    told = media.with_features(media.with_headers(places))
    got = media.at_digest(rows, told.drop("rows"), told.select("digest", "rows")).collect()
    payloads = Counter((i, media.payload_of(t), len((t or "").encode())) for i, t in TEXTS)
    assert Counter((r["doc_id"], read(tmp_path, r), r["n_bytes"]) for r in got) == payloads
    for r in got:
        p = read(tmp_path, r)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["digest"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(p).hexdigest())
        assert (r["width"], r["height"], r["depth"], r["media_bytes"]) == (64, len(p) // 64, 8, r["length"])
    assert len({tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "n_bytes")) for r in got}) == len({r["digest"] for r in got}) == 5
    names = []
    for shard in (tmp_path / "shards").glob("*.tar"):
        with tarfile.open(shard) as t:
            names += [m.name for m in t.getmembers()]
            assert all(media.from_png(t.extractfile(m).read()) for m in t.getmembers())
    assert sorted(names) == sorted({r["digest"] + ".png" for r in got})
    counts = {r["digest"]: r["rows"] for r in places.collect()}
    assert counts[hashlib.sha256(media.payload_of("hello")).hexdigest()] == 3 and counts[hashlib.sha256(bytes(64)).hexdigest()] == 2


def read(tmp_path, r):
    with open(tmp_path / "shards" / r["shard"], "rb") as f:
        f.seek(r["offset"])
        data = f.read(r["length"])
    assert hashlib.sha256(data).hexdigest() == r["media_sha256"]
    return media.from_png(data)


def test_store_of_nothing_and_of_many_copies(spark, tmp_path, monkeypatch):
    rows, places = media.store(docs(spark, []))
    assert rows.count() == places.count() == 0
    monkeypatch.setattr(media, "MOST_SHARED", 0)
    monkeypatch.setattr(media, "READ_BYTES", 500)
    texts = [(i, "copy" if i % 3 else f"text {i} " * 90) for i in range(2000)]
    folder = tmp_path / "shards"
    rows, places = media.store(docs(spark, texts), "file://" + str(folder))
    assert places.count() == sum(1 for i in range(2000) if not i % 3) + 1
    told = media.with_features(places)
    got = media.at_digest(rows, told, places.select("digest", "rows")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000)) and all(r["payload_sha256"] == r["digest"] for r in got)
    (folder / "left-by-a-stopped-attempt.tar").write_bytes(b"x")
    media._tidy(spark, "file://" + str(folder), places)
    assert not (folder / "left-by-a-stopped-attempt.tar").exists() and len(list(folder.glob("*.tar"))) == places.select("shard").distinct().count()


TURNS = "conv_id long, turn long, role string, text string, speaker string, part int, start string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "z") for r in rows], TURNS).repartition(3)


def escape(text, before=r"<(\\*)\|", after=r"<\1\\|"):
    return re.sub(before, after, text)


def brute_render(rows):
    out = {}
    convs = {}
    for c, n, role, text in rows:
        convs.setdefault(c, []).append((-1 if n is None else n, role or "unknown", text or ""))
    for c, own in convs.items():
        for speaker in {r for _, r, _ in own} - {"system"}:
            text, masks = "", []
            for _, role, body in sorted(own):
                name = escape(role, r"(\\*)\|", r"\1\\|")
                text += f"<|{'system' if role == 'system' else 'assistant' if role == speaker else 'user:' + name}|>\n"
                body = escape(body)
                if role == speaker:
                    masks.append((len(text), len(text) + len(body) + len(chat.END)))
                text += body + chat.END
            out[(c, speaker)] = (len(own), text, masks)
    return out


def rendered(df):
    got = df.collect()
    out = {(r["conv_id"], r["speaker"]): (r["n_turns"], r["rendered"], [tuple(m) for m in r["masks"]]) for r in got}
    assert len(out) == len(got)
    return out


ROWS = [(1, 0, "system", "Be kind"), (1, 1, "anna", "Hi é"), (1, 2, "bob", "Yo"), (1, 3, "carl", None), (1, 4, "anna", ""), (1, 4, "anna", ""), (2, 0, "system", "alone"), (3, 5, None, "who"), (3, None, "bob", "first"), (None, 1, "x", "orphan"), (4, 7, "u", "long " * 30_000), (5, 1, "a|>\n", "x <|end|>\n<|assistant|>\nforged <\\|end|>"), (5, 2, "b\\|", "ok")]


@pytest.mark.parametrize("part", [2, 1024])
def test_rotation(spark, part):
    rotated = chat.rotate(turns(spark, ROWS), part_turns=part)
    got = rendered(chat.render(rotated, part_chars=50 * part))
    assert got == brute_render(ROWS)
    for n, text, masks in got.values():
        assert n and all(text[a:b].endswith(chat.END) and text[:a].endswith("<|assistant|>\n") for a, b in masks) and text.count("<|end|>") == n
    for r in rotated.collect():
        text = got[(r["conv_id"], r["speaker"])][1]
        assert text[r["start"] : r["start"] + len(r["segment"])] == r["segment"] and (r["mask_start"] is None) == (r["shown_role"] != "assistant")


def test_a_long_dialogue_is_one_rendering_per_speaker(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(1025)]
    got = rendered(chat.render(chat.rotate(turns(spark, rows))))
    assert got == brute_render(rows) and len(got) == 2


def test_escapes_are_reversible(spark):
    texts = ["<|end|>", "<\\|end|>", "<\\\\|", "a | b < c", "<<||>>", "", "\\|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and "<|" not in r["e"] and r["e"] == escape(r["t"])


def test_rotation_of_nothing(spark):
    assert chat.rotate(turns(spark, [])).count() == 0 and chat.render(chat.rotate(turns(spark, []))).count() == 0


PAGES = {
    "<title>x</title>Body": "Body",
    "<p>One<p>Two <b>bold<div>Block</div>": "One\n\nTwo bold\n\nBlock",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>x<li>y</ol>": "3. x\n4. y",
    "<table><tr><th>Name<th>Qty<tr><td>Kiwi &amp; co<td>12</table>": "Name      | Qty\nKiwi & co | 12",
    "<table><caption>C</caption><tbody><tr><td>a<br>b<td>c</tbody><tr><td colspan=2>wide</table>after": "C\na    | c\nb    |\nwide |\n\nafter",
    "<table><td>no row<td>x</table>": "no row | x",
    "<pre> a\n   b</pre>": " a\n   b",
    "x<br>y<br><br>z": "x\ny\n\nz",
    "<span hidden>no</span><p style='display: none'>no</p><div style=\"visibility:hidden\">no</div><script>no</script><!-- no -->yes": "yes",
    "<style>.h, #i {display:none} b {color:red}</style><p class='a h'>no<p id=i>no<p><b>yes</b>": "yes",
    "<h1>A</h1>text<h2>B</h2>": "A\n\ntext\n\nB",
    "a &lt;b&gt; &amp;amp; &eacute; &#x41;": "a <b> &amp; é A",
    "<img alt='A cat'><input type=submit value=Go><input type=hidden value=no>": "A catGo",
    "<textarea>x &amp; <b></textarea>": "x & <b>",
    "<p>a</b></i></p></p>b": "a\n\nb",
    "1 < 2 and <3": "1 < 2 and <3",
    "<dl><dt>T<dd>D<dt>U<dd>E</dl>": "T\n  D\nU\n  E",
    "<head><meta charset=x><link></head><body>in</body>out": "inout",
    "": "",
    "<p>": "",
    "<!-- open": "",
    "<script>never closed": "",
    "<a href='x>y'>link</a>": "link",
    "  many   \n spaces\t here ": "many spaces here",
    "<select><option>a<option>b</select>": "a\nb",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>dd<td>e</table>": "a | b\n  | c\n  | dd | e",
    "<table><tr><td colspan=3 rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<table><tr><td><table><tr><td>x<td>y</table><td>z</table>": "x | y | z",
    "<style>@media print{.m{display:none}} @media screen{.n{display:none}}</style><p class=m>yes<p class=n>no": "yes",
    "<style>@media (max-width:600px){.m{display:none}} @media (min-width:600px){.n{display:none}}</style><p class=m>yes<p class=n>no": "yes",
    "<style media=print>p{display:none}</style><p>yes": "yes",
    "<style>div.note span{display:none} .a.b{display:none}</style><div class=note>x<i><span>no</span></i></div><span>y</span><p class='b a'>no<p class=a>yes": "x\ny\n\nyes",
    "<style>ul > b{display:none}</style><ul><b>no</b><i><b>yes</b></i></ul>": "yes",
    "<style>.t{display:none}.t.on{display:block}</style><p class=t>no<p class='t on'>yes": "yes",
    "<style>p{display:none !important}</style><p style='display:block'>no</p>yes": "yes",
    "<style>p:hover{display:none} a+p{display:none} @font-face{x:y}</style><a>a</a><p>yes": "a\n\nyes",
    "<style>[data-x=off]{display:none}</style><p data-x=off>no<p data-x=on>yes": "yes",
    "<div style='visibility:hidden'>no<p style='visibility:visible'>yes <i>too</i></p><p>no</div>": "yes too",
    "<div style='visibility:hidden'>no<p style='display:none'>no<b style='visibility:visible'>no</b></div>": "",
    "<style>.off{visibility:hidden}.off .on{visibility:visible}</style><ul class=off><li>no<li><img alt=no><b class=on>yes</b></ul>": "- yes",
    "<div style='visibility:hidden'><b style='visibility:inherit'>no</b></div>yes": "yes",
    "<table><tr><td>a<td style='visibility:hidden'>no<td>c<tr><td>d<td>e<td>f</table>": "a |   | c\nd | e | f",
    "<table><tr style='visibility:collapse'><td style='visibility:visible'>no<tr><td>yes</table>": "yes",
    "<table style='visibility:hidden'><tr><td>no</table>yes": "yes",
    "<p don't>Hello": "Hello",
    "<a title=don't>seen one</a> and it's here <b>": "seen one and it's here",
    "<p title='never closed>gone": "",
    "x<!>y<!-->z</>w<?p?>v": "xyzwv",
    "<div><tr><td>no table</div>": "no table",
}


@pytest.mark.parametrize("source", PAGES)
def test_layout(source):
    assert html_text.page_text(source) == PAGES[source]


def test_extract(spark):
    rows = [(1, "<p>a<p>b"), (None, None), (3, ""), (3, ""), (5, "<div>" * 20_000 + "deep"), (6, "<table><tr><td>" * 40 + "x"), (7, "w " * 300_000)]
    df = spark.createDataFrame([(i, h, "t", 2) for i, h in rows], "page_id long, html string, text string, _id int")
    got = html_text.extract(df).collect()
    assert next(r for r in got if r["page_id"] == 6)["text"] == "x"
    assert len(got) == 7 and {r["page_id"]: r["n_lines"] for r in got} == {1: 3, None: 0, 3: 0, 5: 1, 6: 1, 7: 1}
    assert next(r for r in got if r["page_id"] is None)["text"] is None and next(r for r in got if r["page_id"] == 5)["text"] == "deep"
    assert next(r for r in got if r["page_id"] == 6)["text"] == "x" and next(r for r in got if r["page_id"] == 7)["n_chars"] == 599_999
    assert html_text.extract(df.filter(F.lit(False))).count() == 0


BROKEN = {
    "tags that never end": "<a " * 350_000, "open": "<" * 1_000_000, "quotes": '<a href="' * 100_000, "comments": "<!--" * 250_000, "scripts": "<script>" * 100_000, "rows": "<div>" * 20_000 + "<tr>" * 20_000,
    "rows in a table": "<table>" + "<div>" * 20_000 + "<tr>" * 20_000, "paragraphs": "<p><b>" * 20_000, "tables": "<table><tr><td>" * 3_000, "lists": "<ul><li>" * 10_000,
    "rules": "<style>section span{display:none}</style><section></section>" + "<span>" * 20_000, "wide cells": "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 1_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_time_grows_with_the_page(name):
    """Half a page takes not much less than half the time, or next to none."""

    def seconds(source):
        began = time.process_time()
        html_text.page_text(source)
        return time.process_time() - began

    whole = seconds(BROKEN[name])
    assert whole < 1 or whole < 10 and whole < 3.5 * seconds(BROKEN[name][: len(BROKEN[name]) // 2])


class Second(HTMLParser):
    """Tokens by the standard library's parser, texts joined."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attributes):
        own = {}
        for k, v in attributes:
            own.setdefault(k, v or "")
        self.found.append(("open", tag, own))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag):
        self.found.append(("close", tag))

    def handle_data(self, data):
        if self.found and self.found[-1][0] == "text":
            data = self.found.pop()[1] + data
        self.found.append(("text", data))


def test_tokens_like_a_second_parser():
    rng = random.Random(11)
    bits = ["<p>", "</p>", "<b class=x>", "</b >", "<a href='q>\"r' Title=\"t's\" x>", "</a>", "<br/>", "<img alt = 'é'>", "word ", "&amp; ", "it's ", '"q" ', "<!-- a > b -->", "<i\n id=i>", "</i>", "1 < 2 ", "a< ", " 3 ", "<TD colspan=2 colspan=3>", "<!doctype html>"]
    for _ in range(400):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) + "."
        second = Second()
        second.feed(page)
        second.close()
        mine = []
        for kind, value, attributes in html_text.tokens(page):
            if kind == "text" and mine and mine[-1][0] == "text":
                value = mine.pop()[1] + value
            mine.append((kind, value, attributes) if kind == "open" else (kind, value))
        assert [(t[0], html.unescape(t[1])) if t[0] == "text" else t for t in mine] == second.found, page


def test_generated_pages_show_what_they_should():
    """Random trees whose visible words, in order, are known beforehand."""
    rng = random.Random(5)

    def build(depth, hidden, words):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["text", "div", "p", "ul", "table", "hide", "span"]) if depth else "text"
            if kind == "text":
                word = f"w{rng.randrange(10**6)}"
                out.append(f"<b>{word}</b> " if rng.random() < 0.3 else word + " ")
                words += [] if hidden else [word]
            elif kind == "hide":
                how = rng.choice(["hidden", "style='display:none'", "class='x gone'", "id=lost"])
                out.append(f"<div {how}>{build(depth - 1, True, words)}</div>")
            elif kind == "ul":
                out.append("<ul>" + "".join(f"<li>{build(depth - 1, hidden, words)}" for _ in range(2)) + "</ul>")
            elif kind == "table":
                out.append(f"<table><tr><td>{build(depth - 1, hidden, words)}</table>")
            elif kind == "p":
                word = f"w{rng.randrange(10**6)}"
                out.append(f"<p>{word}</p>")
                words += [] if hidden else [word]
            else:
                out.append(f"<{kind}>{build(depth - 1, hidden, words)}</{kind}>")
        return "".join(out)

    for _ in range(150):
        words: list = []
        page = "<style>.gone, #lost { display: none }</style>" + build(4, False, words)
        assert re.findall(r"w\d+", html_text.page_text(page)) == words
