"""Course structure from pages: titles, learning paths, modules, units.

The children of a page are computed inside its row: first-wins de-duplication
sorts the page's own link array by (key, position), so no shuffle is needed
and cost is n log n in the links of one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from coursemill.functions import markup, urls
from coursemill.functions.columns import fresh, let


def page_title(doc: str) -> str:
    """Text of the first h1, '' when there is none."""
    first = f"get({markup.elements_of(doc, ['h1'])}, 0)"
    return f"coalesce({let(first, lambda e: f'IF({e} IS NULL, NULL, {markup.element_text(doc, e)})')}, '')"


def anchors(doc: str) -> str:
    """ARRAY<STRUCT<pos, href, title>> of all anchors."""
    e = fresh("e")
    return f"""transform({markup.elements_of(doc, ['a'])}, {e} -> named_struct(
        'pos', {e}.pos, 'href', {markup.attribute(f'{e}.raw', 'href')},
        'title', {markup.element_text(doc, e)}))"""


def first_wins(items: str, key: str) -> str:
    """Keep the first struct per ``key`` (by ``pos``), back in ``pos`` order."""
    x, y, i, z = fresh("x"), fresh("y"), fresh("i"), fresh("z")
    keyed = f"sort_array(transform({items}, {x} -> named_struct('k', {x}.{key}, 'pos', {x}.pos, 'item', {x})))"

    def firsts(s: str) -> str:
        kept = f"filter({s}, ({y}, {i}) -> {i} = 0 OR get({s}, {i} - 1).k <> {y}.k)"
        return f"sort_array(transform({kept}, {z} -> {z}.item))"

    return let(keyed, firsts)


def path_links(doc: str, site: str) -> str:
    """ARRAY<STRUCT<pos, learn_uid, title, url>>; no de-duplication."""
    e, u, s = fresh("e"), fresh("u"), fresh("s")
    uids = f"""filter(transform({markup.elements_of(doc, ['article'])}, {e} -> named_struct(
        'pos', {e}.pos, 'uid', {markup.attribute(f'{e}.raw', 'data-learn-uid')})),
        {u} -> startswith({u}.uid, 'learn.'))"""

    def row(slug: str) -> str:
        return f"""named_struct('pos', {s}.pos, 'learn_uid', {s}.uid,
            'title', {urls.path_title(slug)}, 'url', {urls.path_url(slug, site)})"""

    return f"transform({uids}, {s} -> {let(urls.uid_slug(f'{s}.uid'), row)})"


def module_candidates(links: str, url: str, site: str) -> str:
    """Titled links whose href mentions modules, with normalised URL."""
    l, m = fresh("l"), fresh("m")
    wanted = f"filter({links}, {l} -> contains({l}.href, 'modules') AND {l}.title <> '')"
    return f"""transform({wanted}, {m} -> named_struct('pos', {m}.pos, 'title', {m}.title,
        'href', {m}.href, 'url', {urls.module_url(url, f'{m}.href', site)}))"""


def module_links(links: str, url: str, site: str) -> str:
    """ARRAY<STRUCT<pos, title, href, url>>, first link per URL wins."""
    return first_wins(module_candidates(links, url, site), "url")


def unit_candidates(links: str, url: str) -> str:
    """Unit links in document order, numbered, before de-duplication."""
    l, u, n = fresh("l"), fresh("u"), fresh("n")
    wanted = f"filter({links}, {l} -> {urls.is_unit_link(f'{l}.href', f'{l}.title')})"
    joined = f"""transform({wanted}, {u} -> named_struct('pos', {u}.pos, 'title', {u}.title,
        'href', {u}.href, 'url', {urls.url_join(url, f'{u}.href')}))"""
    return f"""transform({joined}, {n} -> named_struct(
        'pos', {n}.pos, 'number', {urls.unit_number(f'{n}.url', f'{n}.title')},
        'title', {n}.title, 'href', {n}.href, 'url', {n}.url))"""


def unit_links(links: str, url: str) -> str:
    """ARRAY<STRUCT<number, pos, title, url, href>> by number, then document order."""
    x = fresh("x")
    return f"""sort_array(transform({first_wins(unit_candidates(links, url), 'url')}, {x} -> named_struct(
        'number', {x}.number, 'pos', {x}.pos, 'title', {x}.title, 'url', {x}.url, 'href', {x}.href)))"""


def page_titles(pages: DataFrame) -> DataFrame:
    """``(page_id, title)``; a page that failed to load has no title."""
    title = let(markup.document("html", False), page_title)
    return pages.selectExpr("page_id", f"IF(html IS NULL, NULL, {title}) AS title")


def _children(pages: DataFrame, array, *columns: str) -> DataFrame:
    """Explode a per-page child array into ``(url, ord, columns...)``."""
    exploded = pages.selectExpr("url", f"posexplode({let(markup.document('html', False), array)}) AS (ord, c)")
    return exploded.selectExpr("url", "CAST(ord AS BIGINT) AS ord", *columns)


def paths(pages: DataFrame, site: str = urls.SITE) -> DataFrame:
    """Learning paths listed by each course page, in document order."""
    return _children(
        pages, lambda doc: path_links(doc, site), "c.learn_uid AS learn_uid", "c.title AS title", "c.url AS path_url"
    )


def modules(pages: DataFrame, site: str = urls.SITE) -> DataFrame:
    """Modules listed by each learning-path page, first link per URL."""
    return _children(pages, lambda doc: module_links(anchors(doc), "url", site), "c.title AS title", "c.url AS module_url")


def module_refs(pages: DataFrame, site: str = urls.SITE) -> DataFrame:
    """All titled module links before de-duplication."""
    return _children(
        pages,
        lambda doc: module_candidates(anchors(doc), "url", site),
        "c.title AS title", "c.href AS href", "c.url AS module_url",
    )


def units(pages: DataFrame) -> DataFrame:
    """Units listed by each module page, de-duplicated and ordered."""
    return _children(
        pages,
        lambda doc: unit_links(anchors(doc), "url"),
        "c.number AS number", "c.title AS title", "c.url AS unit_url", "c.href AS href",
    )


def unit_refs(pages: DataFrame) -> DataFrame:
    """All unit links in document order, before de-duplication."""
    return _children(
        pages,
        lambda doc: unit_candidates(anchors(doc), "url"),
        "c.number AS number", "c.title AS title", "c.url AS unit_url", "c.href AS href",
    )
