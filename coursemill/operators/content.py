"""Unit content: text, headings, code, images with context, links."""

from __future__ import annotations

from pyspark.sql import DataFrame

from coursemill.functions import markup, rules, urls
from coursemill.functions.columns import fresh, let

MIN_CODE = 10
MIN_FOLLOWING = 10
MAX_FOLLOWING = 200


def _root(doc: str) -> str:
    """Span of the content root; the whole document when there is none."""
    e = fresh("e")
    found = f"get(filter({doc}.elements, {e} -> {e}.pos = {doc}.root), 0)"
    whole = f"""named_struct('pos', -1, 'tag', '', 'raw', '', 't0', 0,
        't1', size({doc}.texts), 'stop', {doc}.n, 'captions', 0)"""
    return f"coalesce({found}, {whole})"


def _inside(root: str, item: str) -> str:
    return f"{item}.pos > {root}.pos AND {item}.pos < {root}.stop"


def text(doc: str, root: str) -> str:
    """Text nodes of the root, one per line; blank ones are gone since parsing."""
    return f"array_join(slice({doc}.texts, {root}.t0 + 1, {root}.t1 - {root}.t0), '\\n')"


def headings(doc: str, root: str) -> str:
    e, h = fresh("e"), fresh("h")
    inside = f"filter({markup.elements_of(doc, markup.HEADING_TAGS)}, {e} -> {_inside(root, e)})"
    return f"""transform({inside}, {h} -> named_struct(
        'level', CAST(substr({h}.tag, 2) AS INT), 'text', {markup.element_text(doc, h)}))"""


def code_blocks(doc: str, root: str) -> str:
    """Text of every code and pre element longer than ten characters."""
    e, c, t = fresh("e"), fresh("c"), fresh("t")
    inside = f"filter({markup.elements_of(doc, markup.CODE_TAGS)}, {e} -> {_inside(root, e)})"
    texts = f"transform({inside}, {c} -> {markup.element_text(doc, c)})"
    return f"filter({texts}, {t} -> length({t}) > {MIN_CODE})"


def links(doc: str, root: str) -> str:
    e, a, l = fresh("e"), fresh("a"), fresh("l")
    inside = f"filter({markup.elements_of(doc, ['a'])}, {e} -> {_inside(root, e)})"
    rows = f"""transform({inside}, {a} -> named_struct(
        'url', {markup.attribute(f'{a}.raw', 'href')}, 'text', {markup.element_text(doc, a)}))"""
    return f"filter({rows}, {l} -> {l}.url <> '' AND {l}.text <> '')"


def images(doc: str, root: str, url: str, site: str) -> str:
    """Images of the root with resolved URL, class and surroundings.

    The fold counted headings, paragraphs and figures up to each image, and
    captions up to each figure, so the neighbours are direct index lookups. Their scope is the whole document.
    """
    i, src, img = fresh("i"), fresh("src"), fresh("img")
    inside = f"filter({doc}.images, {i} -> {_inside(root, i)})"
    with_src = f"""filter(transform({inside}, {src} -> named_struct(
        'at', {src}, 'src', {markup.attribute(f'{src}.raw', 'src')})), {src} -> {src}.src <> '')"""

    def text_or_empty(element: str, shape=lambda t: t) -> str:
        body = let(element, lambda e: f"IF({e} IS NULL, NULL, {markup.element_text(doc, e)})")
        return f"coalesce({let(body, shape)}, '')"

    def rows(heads: str, paras: str, figures: str, captions: str) -> str:
        def caption(figure: str) -> str:
            first = f"get({captions}, {figure}.captions)"
            return let(first, lambda c: f"IF({c}.pos < {figure}.stop, {c}, NULL)")

        context = f"""named_struct(
            'preceding_heading', {text_or_empty(f'get({heads}, {img}.at.headings - 1)')},
            'following_text', {text_or_empty(
                f'get({paras}, {img}.at.paragraphs)',
                lambda t: f"IF(length({t}) > {MIN_FOLLOWING}, substr({t}, 1, {MAX_FOLLOWING}), '')")},
            'figure_caption', {text_or_empty(let(f'get({figures}, {img}.at.figure - 1)', caption))},
            'parent_section', '')"""

        def with_alt(alt: str) -> str:
            return let(
                urls.image_url(url, f"{img}.src", site),
                lambda absolute: f"""named_struct('src', {img}.src, 'absolute_url', {absolute}, 'alt_text', {alt},
                    'title', {markup.attribute(f'{img}.at.raw', 'title')},
                    'filename', {urls.image_filename(absolute)},
                    'image_type', {rules.image_type(f'{img}.src', alt)}, 'context', {context})""",
            )

        return f"transform({with_src}, {img} -> {let(markup.attribute(f'{img}.at.raw', 'alt'), with_alt)})"

    return let(
        markup.elements_of(doc, markup.HEADING_TAGS),
        lambda heads: let(
            markup.elements_of(doc, ["p"]),
            lambda paras: let(
                markup.elements_of(doc, ["figure"]),
                lambda figures: let(
                    markup.elements_of(doc, ["figcaption"]),
                    lambda captions: rows(heads, paras, figures, captions),
                ),
            ),
        ),
    )


def record(doc: str, url: str, site: str, fields: list[str] | None = None) -> str:
    """STRUCT of the requested content fields of a cleaned document."""
    builders = {
        "content": lambda r: text(doc, r),
        "headings": lambda r: headings(doc, r),
        "code_blocks": lambda r: code_blocks(doc, r),
        "images": lambda r: images(doc, r, url, site),
        "links": lambda r: links(doc, r),
    }
    wanted = fields or list(builders)
    return let(_root(doc), lambda r: "named_struct(" + ", ".join(f"'{f}', {builders[f](r)}" for f in wanted) + ")")


def unit_content(pages: DataFrame, site: str = urls.SITE, fields: list[str] | None = None) -> DataFrame:
    """``(page_id, url, content, headings, code_blocks, images, links)``.

    One pass over the page rows, no shuffle. ``fields`` limits what is built.
    """
    clean = let(markup.document("html", True), lambda doc: record(doc, "url", site, fields))
    return pages.selectExpr("page_id", "url", f"IF(html IS NULL, NULL, {clean}) AS r").select("page_id", "url", "r.*")


def root_spans(pages: DataFrame) -> DataFrame:
    """Content root chosen per page ``(page_id, root_tag, root_pos, root_stop)``."""
    root = let(markup.document("html", True), _root)
    return pages.where("html IS NOT NULL").selectExpr("page_id", f"{root} AS r").selectExpr(
        "page_id", "r.tag AS root_tag", "CAST(r.pos AS BIGINT) AS root_pos", "CAST(r.stop AS BIGINT) AS root_stop"
    )


def kept_text(pages: DataFrame) -> DataFrame:
    """Text nodes left in the root after boilerplate removal, one row each."""
    def nodes(doc: str) -> str:
        return let(_root(doc), lambda r: f"slice({doc}.texts, {r}.t0 + 1, {r}.t1 - {r}.t0)")

    exploded = pages.selectExpr("page_id", f"posexplode({let(markup.document('html', True), nodes)}) AS (pos, text)")
    return exploded.selectExpr("page_id", "CAST(pos AS BIGINT) AS ord", "text")


def items(pages: DataFrame, field: str, columns: list[str], site: str = urls.SITE) -> DataFrame:
    """One row per element of an array field: ``(page_id, ord, columns...)``."""
    record_field = let(markup.document("html", True), lambda doc: f"({record(doc, 'url', site, [field])}).{field}")
    exploded = pages.selectExpr("page_id", f"posexplode({record_field}) AS (ord, c)")
    return exploded.selectExpr("page_id", "CAST(ord AS BIGINT) AS ord", *columns)
