"""Column rules against Python's own behaviour and hand-made cases."""

import re
from urllib.parse import urljoin

import pytest

from coursemill.functions import rules, urls
from coursemill.operators import structure

SITE = urls.SITE


def values(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).selectExpr(f"{expression} AS v").collect()]


def test_url_join_equals_urljoin(spark):
    bases = ["https://h.org/a/b/c", "https://h.org/a/b/", "https://h.org", "http://h.org/x?q=1#f"]
    refs = [
        "../x", "./y", "?z=1", "#f", "/abs/..//z", "//host/p", "http://other/a", "", "a/b/../../../c", "mailto:x",
        "..", ".", "a//b", "/..", "https:foo", "x?y#z", "../../../../q", "a/./b/..", "é/ü", "a b",
    ]
    cases = [(b, r) for b in bases for r in refs]
    got = values(spark, urls.url_join("b", "r"), cases, "b STRING, r STRING")
    assert got == [urljoin(b, r) for b, r in cases]


def test_title_case(spark):
    slugs = ["ab204-3d-intro", "what-s-new", "ALL-caps", "", "a1b2"]
    got = values(spark, urls.path_title("s"), [(s,) for s in slugs], "s STRING")
    assert got == [s.replace("-", " ").title() for s in slugs]


def test_output_slug(spark):
    titles = ["C#: Été & more_x - 2", "  Plain Title ", "", "a -- b c", "日本 語!"]
    got = values(spark, urls.output_slug("t"), [(t,) for t in titles], "t STRING")
    safe = [re.sub(r"[^\w\s-]", "", t).strip() for t in titles]
    assert got == [re.sub(r"[-\s]+", "-", t).lower() for t in safe]


@pytest.mark.parametrize("href, expected", [
    ("../../modules/a/", f"{SITE}/en-us/training/modules/a/"),
    ("../../modules/a/../../modules/b", f"{SITE}/en-us/training/modules/a/{SITE}/en-us/training/modules/b/"),
    ("/modules/a?x=1", f"{SITE}/en-us/training/modules/a?x=1/"),
    ("/training/modules/a", f"{SITE}/training/modules/a/"),
    ("https://o.org/modules/z", "https://o.org/modules/z/"),
    ("modules/q", f"{SITE}/en-us/training/paths/p/modules/q/"),
])
def test_module_url(spark, href, expected):
    row = [(f"{SITE}/en-us/training/paths/p/", href)]
    assert values(spark, urls.module_url("p", "h", SITE), row, "p STRING, h STRING") == [expected]


@pytest.mark.parametrize("href, title, kept", [
    ("5-x", "", True), ("intro/introduction", "", False), ("20-x", "T", False), ("20-summary", "T", True),
    ("19-x", "", True), ("0-x", "", False), ("exercise", "T", True), ("1x-y", "T", False),
])
def test_unit_link_precedence(spark, href, title, kept):
    assert values(spark, urls.is_unit_link("h", "t"), [(href, title)], "h STRING, t STRING") == [kept]


@pytest.mark.parametrize("url, title, number", [
    ("/training/modules/3-things/summary", "Summary", 3), ("/m/x", "Exercise summary", 999), ("/m/x", "7. Do", 7),
    ("/m/x", "Module assessment", 998), ("/m/x", "Knowledge-check", 998), ("/m/x", "Exercise", 900),
    ("/m/x", "Other", 500), ("/m/12-y", "1. a", 12), ("/m/x", "INTRODUCTION", 1),
])
def test_unit_number(spark, url, title, number):
    assert values(spark, urls.unit_number("u", "t"), [(url, title)], "u STRING, t STRING") == [number]


@pytest.mark.parametrize("src, expected, filename", [
    ("../../wwl/a.png", f"{SITE}/en-us/wwl/a.png", "a.png"), ("/m/a.png?u=/z", f"{SITE}/m/a.png?u=/z", "z"),
    ("//cdn/x.png", f"{SITE}//cdn/x.png", "x.png"), ("media/p.svg?v=1", "https://h.org/u/media/p.svg?v=1", "p.svg"),
    ("https://c.org/i.png", "https://c.org/i.png", "i.png"),
])
def test_image_url_and_filename(spark, src, expected, filename):
    row = spark.createDataFrame([("https://h.org/u/1", src)], "p STRING, s STRING").selectExpr(
        f"{urls.image_url('p', 's', SITE)} AS u"
    ).selectExpr("u", f"{urls.image_filename('u')} AS f").first()
    assert (row.u, row.f) == (expected, filename)


@pytest.mark.parametrize("src, alt, kind", [
    ("build-guide.png", "diagram", "screenshot"), ("x.png", "Button", "icon"), ("x.png", "Syntax", "code_example"),
    ("ARCHITECTURE.png", "", "diagram"), ("x.png", "Portal", "screenshot"), ("x.png", "", "illustration"),
    ("plot.png", "portal", "chart"),
])
def test_image_type(spark, src, alt, kind):
    assert values(spark, rules.image_type("s", "a"), [(src, alt)], "s STRING, a STRING") == [kind]


@pytest.mark.parametrize("percentage, grade", [
    (85.0, "EXCELLENT"), (84.96, "PASS"), (70.0, "PASS"), (69.99, "BORDERLINE"), (59.9, "NEEDS WORK"), (None, None),
])
def test_grade(spark, percentage, grade):
    assert values(spark, rules.grade("p"), [(percentage,)], "p DOUBLE") == [grade]


def test_first_link_per_url_wins_and_empty_titles_do_not_block(spark):
    html = (
        "<h1>P</h1><a href='/modules/m'></a><a href='/modules/m'>First</a><a href='/modules/m/'>Second</a>"
        "<a href='/modules/a'>Later</a>"
    )
    df = spark.createDataFrame([("https://h.org/p/", html)], "url STRING, html STRING")
    rows = structure.modules(df, "https://h.org").orderBy("ord").collect()
    assert [(r.ord, r.title, r.module_url) for r in rows] == [
        (0, "First", "https://h.org/en-us/training/modules/m/"), (1, "Later", "https://h.org/en-us/training/modules/a/"),
    ]


def test_paths_are_not_deduplicated(spark):
    html = "<article data-learn-uid='learn.x.a-b'></article>" * 2 + "<article data-learn-uid='other.x'></article>"
    df = spark.createDataFrame([("https://h.org/c", html)], "url STRING, html STRING")
    assert [(r.ord, r.title) for r in structure.paths(df).orderBy("ord").collect()] == [(0, "A B"), (1, "A B")]
