"""Extraction against planted pages, a plain style tree, and the given pages' articles cut out by hand."""

import html
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from panelforge.llm import html_extraction as he

SCHEMA = "page_id long, url string, html string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("host", "key", "salt", "text", "n", "n_chars", "above")})


def run(spark, rows, **how):
    return sorted(map(tuple, he.extract(table(spark, rows), **how).collect()), key=repr)


def by_hand(source):
    """The article of a page whose article holds only headings, paragraphs, b and br."""
    inside = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = re.sub("<[^>]*>", "\0", re.sub("<br>", " ", re.sub("</?b>", "", inside))).split("\0")
    return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def test_given_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = [(r.page_id, r.url, by_hand(r.html), len(by_hand(r.html))) for r in rows]
    assert sorted(map(tuple, he.op12_html_extraction(spark, sf).collect())) == sorted(want)


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b", "a\nb"),
        ("plain  text &amp; more space", "plain text & more space"),
        ("a < b <i>c</i>", "a < b c"),
        ("<div>x<span class=ad>no</span>y</div>", "xy"),
        ("<body><header>top</header><article><header><h1>T</h1></header><p>x<aside>no</aside>y</article>out", "T\nx\ny"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<b><p>t</b>u</p>v", "tu\nv"),
        ("x<!-- > --> y <!-->z<!-- never closed", "x y z"),
        ('<p title="a > b">q</p><a href="x<y">w</a><img alt=">">', "q\nw"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("&lt;b&gt; &amp;amp; &#65;&#xD800; &am", "<b> &amp; A� &am"),
        ('<div class="wrap sidebar-left"><div id=content><p>hi</p></div><div class=sidebar>no</div></div>', "hi"),
        ('text <a href="', "text"),
        ('<script>var a="</p>"; if (a<b) x</script>ok<script>cut', "ok"),
        ("<title>t</title><style>p{}</style><h1>h</h1>foo<br>bar<script>x</script>baz", "h\nfoo barbaz"),
        ('<article>A<div class="comments"><article>c</article></div><form>f</form><div class="cookie-notice">n</div><p hidden>h</p></article>', "A"),
        ('<nav><article>menu</article></nav><main>M<div role="navigation">r</div></main><footer>f</footer>', "M"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("</div></article></p>stray", "stray"),
    ],
)
def test_markup(source, text):
    assert he.main_text(source, "", frozenset()) == text


def site(pages, host="a.example", copies=False):
    """Pages of undeclared parts: a strip and a list that repeat, and prose that doesn't (or does, in copies)."""
    r = random.Random(1)
    rows = []
    for k in range(pages):
        r = random.Random(0 if copies else k)
        prose = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(r.randint(4, 9))]
        body = "".join(f"<p>{p}</p>" for p in prose)
        rows.append((k, f"http://{host}/{k}", f'<div id="c{k}"><div class="strip">All of our offers<b>!</b></div><section>{body}<p>Shared passage.</p></section><div><ul><li>Legal</li><li>Help</li></ul></div></div>', "\n".join([*prose, "Shared passage."])))
    return rows


@pytest.mark.parametrize("sent", [1 << 20, -1])
def test_branches_that_say_nothing_go(spark, sent):
    """Repeated undeclared branches go from a site of many pages; not from one of two pages, of copies, or without a host."""
    many, few, copied = site(20), site(2, "b.example"), site(6, "c.example", copies=True)
    none = [(k, None, h, t) for k, _, h, t in site(5)]
    rows = many + [(100 + k, u, h, t) for k, u, h, t in few] + [(200 + k, u, h, t) for k, u, h, t in copied] + [(300 + k, u, h, t) for k, u, h, t in none] + [many[3]]
    got = run(spark, [r[:3] for r in rows], sent_bytes=sent)
    whole = lambda text: "\n".join(["All of our offers!", text, "Legal", "Help"])
    want = [(k, u, t if k < 100 else whole(t), len(t if k < 100 else whole(t))) for k, u, _, t in rows]
    assert got == sorted(want, key=repr)


def test_importance_is_that_of_a_plain_tree(spark):
    rows = site(7)
    found = {r.key: r for r in he.style_tree(table(spark, [r[:3] for r in rows]).withColumn("host", F.lit("h"))).collect()}
    main = he.key_of("h", None, "main")
    pages = [[t for t in re.findall(r"<(?:p|li|div class=\"strip\")>(.*?)</", re.sub("</?b>", "", h))] for _, _, h, _ in rows]
    counts = {}
    for k, blocks in enumerate(pages):
        for b in blocks:
            counts.setdefault(b, {}).setdefault(k, 0)
            counts[b][k] += 1

    def spread(of):
        return -sum(n / sum(of.values()) * math.log(n / sum(of.values()), 7) for n in of.values())

    content = 1 - sum(map(spread, counts.values())) / len(counts)
    assert found[main].pages == 7 and found[main].blocks == sum(map(len, pages)) and found[main].above == 0
    assert found[main].importance == pytest.approx(0.1 * 0 + 0.9 * content)  # one presentation: a div
    box = he.key_of("h", main, "div c0 ")
    strip = found[he.key_of("h", box, "div  strip")]
    assert strip.pages == 7 and strip.blocks == 7 and strip.importance == pytest.approx(0)
    prose = found[he.key_of("h", he.key_of("h", box, "section"), "p")]
    own = [of for b, of in counts.items() if b not in ("All of our offers!", "Legal", "Help")]
    assert prose.importance == pytest.approx(1 - sum(map(spread, own)) / len(own))


def test_long_deep_and_empty(spark):
    assert run(spark, []) == []
    deep = "<div>" * 20_000 + "x" + "<p>y" * 3_000
    long = "<article>" + "<p>word word</p>" * 100_000 + "</article>"
    quotes = "<a '\">" * 50_000 + "z"
    got = {r[0]: r[2] for r in run(spark, [(1, "http://h/", deep), (2, "http://h/", long), (3, "http://h/", None), (4, "http://h/", quotes), (5, "http://h/", "<p " * 100_000)])}
    assert got[1] == "\n".join(["x", *["y"] * 3_000]) and got[2] == "\n".join(["word word"] * 100_000) and got[3] == "" and got[4].endswith("z")
