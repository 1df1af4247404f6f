"""The parser expressions against an independent stack reader."""

import random
import time

import pytest
import reader

from coursemill.functions import markup
from coursemill.operators import content, structure
from coursemill.operators import markup as markup_ops
from coursemill.plans.fixtures import table

SCHEMA = "page_id BIGINT, url STRING, html STRING"


def pages(spark, docs):
    rows = [(i, f"https://h.org/p/{i}/", d) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA)


def our_elements(df):
    found = {}
    for row in markup_ops.elements(df).orderBy("page_id", "pos").collect():
        found.setdefault(row.page_id, []).append((row.tag, row.text))
    return found


def tag_soup(rng):
    """Random, often malformed markup: unclosed, crossed and stray tags."""
    tags = ["p", "b", "div", "h1", "h3", "a", "li", "article", "main", "nav", "header", "code", "pre", "figure", "i"]
    parts = []
    for _ in range(rng.randint(1, 60)):
        kind = rng.random()
        tag = rng.choice(tags)
        if kind < 0.35:
            parts.append(f"<{tag}>")
        elif kind < 0.6:
            parts.append(f"</{tag}>")
        elif kind < 0.65:
            parts.append("<br>")
        elif kind < 0.7:
            parts.append("<!-- c <p> -->")
        elif kind < 0.73:
            parts.append(f"<{tag}/>")
        else:
            parts.append(rng.choice([" a ", "b c", "&amp;x", "é&eacute;", " ", "1 < 2", "&#65;", "\n"]))
    return "".join(parts)


def test_tag_soup_matches_stack_reader(spark):
    rng = random.Random(7)
    docs = [tag_soup(rng) for _ in range(400)]
    df = pages(spark, docs).repartition(8)
    ours = our_elements(df)
    for i, doc in enumerate(docs):
        assert ours.get(i, []) == reader.elements(doc), doc
    texts = {r.page_id: r.content for r in content.unit_content(df, fields=["content"]).collect()}
    for i, doc in enumerate(docs):
        assert texts[i] == reader.content(doc), doc


def test_both_views_from_one_fold(spark):
    rng = random.Random(11)
    df = pages(spark, [tag_soup(rng) for _ in range(150)]).selectExpr(
        f"{markup.documents('html')} AS both", f"{markup.document('html', True)} AS clean",
        f"{markup.document('html', False)} AS whole",
    )
    assert df.where("both.clean <> clean").count() == 0
    assert df.where("both.whole.texts <> whole.texts OR both.whole.elements <> whole.elements").count() == 0


def test_driver_pages_match_stack_reader(spark, sf_dir):
    rows = table(spark, sf_dir, "unit_pages").where("html IS NOT NULL")
    docs = {r.page_id: r.html for r in rows.collect()}
    ours = our_elements(rows)
    texts = {r.page_id: r.content for r in content.unit_content(rows, fields=["content"]).collect()}
    for i, doc in docs.items():
        assert ours[i] == reader.elements(doc)
        assert texts[i] == reader.content(doc)


def test_long_page_and_long_token(spark):
    many = "<main>" + "".join(f"<p>item {i}</p>" for i in range(5000)) + "</main>"
    wide = f'<main><img src="data:{"x" * 2_000_000}"><script>{"y" * 1_000_000}</script><p>end</p></main>'
    deep = "<main>" + "<b>" * 3000 + "x" + "</b>" * 3000 + "</main>"
    text = "<main>" + "a < b " * 100_000 + "</main>"
    crowded = "<main><a " + "x='1' " * 50_000 + "href='z'>link</a></main>"
    df = pages(spark, [many, wide, deep, text, crowded])
    assert [l.url for l in content.unit_content(df).where("page_id = 4").first().links] == ["z"]
    got = [r.content for r in content.unit_content(df, fields=["content"]).orderBy("page_id").collect()]
    assert got[0].split("\n") == [f"item {i}" for i in range(5000)]
    assert got[1:3] == ["end", "x"]
    assert got[3] == ("a < b " * 100_000).strip()


def test_unclosed_script_hides_the_rest(spark):
    df = pages(spark, ["<main><p>a</p><script>var x = '<p>b</p>';"])
    assert content.unit_content(df, fields=["content"]).first().content == "a"


def test_entities(spark):
    cases = {
        "&lt;b&gt; &quot;x&quot;": '<b> "x"', "&amp;amp;": "&amp;", "&eacute;&#233;&#xE9;": "ééé",
        "&#128;": "€", "&#x1F600;": "\U0001F600", "&unknown;": "&unknown", "a & b": "a & b", "&#0;": "�",
        "&nbsp;x": " x", "&notin;": "∉", "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING").selectExpr(
        "t", f"{markup.decode_entities('t')} AS d"
    )
    assert {r.t: r.d for r in df.collect()} == cases


def test_attributes(spark):
    cases = {
        '<a href="x">': "x", "<a href='y z'>": "y z", "<a class=k href=v>": "v", "<a>": "", "<a href>": "",
        '<a data-href="n">': "", '<a title="href=\'no\'" href="yes">': "yes", '<A HREF="Up&amp;q">': "Up&q",
        '<a href="">': "", '<a\nhref = "s">': "s", "<a href=1 href='2'>": "2", "<a x/href=3>": "3",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING").selectExpr("t", f"{markup.attribute('t', 'href')} AS v")
    assert {r.t: r.v for r in df.collect()} == cases


def test_code_inside_pre_is_reported_twice(spark):
    df = pages(spark, ["<main><pre><code>print(1234567)</code></pre><code>short</code></main>"])
    assert content.unit_content(df).first().code_blocks == ["print(1234567)"] * 2


def test_image_context(spark):
    html = (
        "<header><h2>Site</h2></header><main><img src='first.png'><h3>Part</h3><p>0123456789</p>"
        "<figure><div><img src='ui.png' alt='diagram'></div><figcaption>Cap <b>one</b></figcaption></figure>"
        f"<p>{'w' * 300}</p></main>"
    )
    first, second = content.unit_content(pages(spark, [html])).first().images
    assert first.context.preceding_heading == "Site"
    assert first.context.following_text == ""  # ten characters are not enough
    assert first.context.figure_caption == ""
    assert second.context.preceding_heading == "Part"
    assert second.context.following_text == "w" * 200
    assert second.context.figure_caption == "Capone"
    assert (first.image_type, second.image_type) == ("illustration", "screenshot")


def test_failed_page_differs_from_empty_page(spark):
    rows = content.unit_content(pages(spark, ["", None])).orderBy("page_id").collect()
    assert (rows[0].content, rows[1].content) == ("", None)
    titles = structure.page_titles(pages(spark, ["<p>x</p>", None])).orderBy("page_id").collect()
    assert [t.title for t in titles] == ["", None]


@pytest.mark.parametrize("width", [1, 2, 5])
def test_few_tokens_at_once_give_the_same_spans(spark, monkeypatch, width):
    """Elements left open over many chunks, closed across them, and stray closes."""
    rng = random.Random(width)
    soup = [tag_soup(rng) for _ in range(60)]
    tags = ["b", "i", "p", "div", "figure", "figcaption", "nav", "main"]
    soup += ["".join(rng.choice([f"<{rng.choice(tags)}>", f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "x ", '<img src="a">'])
                     for _ in range(rng.randrange(20, 120))) for _ in range(60)]
    wide = [r.asDict(True) for r in content.unit_content(pages(spark, soup)).orderBy("page_id").collect()]
    monkeypatch.setattr(markup, "_CHUNK", width)
    ours = our_elements(pages(spark, soup))
    for i, doc in enumerate(soup):
        assert ours.get(i, []) == reader.elements(doc), doc
    assert [r.asDict(True) for r in content.unit_content(pages(spark, soup)).orderBy("page_id").collect()] == wide


def test_captions_are_looked_up(spark):
    one = '<figure><img src="a.png"><figcaption>C{}</figcaption></figure>'
    docs = ["<main>" + "".join(one.format(i) for i in range(300)) + "</main>",
            '<main><figure><img src="a"><figure><img src="b"></figure><figcaption>late</figcaption></figure>'
            '<figure><img src="c"></figure><figcaption>outside</figcaption><img src="d"></main>']
    rows = content.items(pages(spark, docs), "images", ["c.context.figure_caption AS caption"]).orderBy("page_id", "ord").collect()
    assert [r.caption for r in rows] == [f"C{i}" for i in range(300)] + ["late", "", "", ""]


def test_time_grows_alike_with_open_and_closed_tags(spark):
    def seconds(doc):
        df = pages(spark, [doc])
        start = time.perf_counter()
        our_elements(df)
        return time.perf_counter() - start

    seconds("<b>x</b>")
    assert seconds("<b>x" * 8000) < 2 * seconds("<b>x</b>" * 8000) + 2
