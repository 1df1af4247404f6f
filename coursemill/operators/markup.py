"""Token, text, attribute and span relations over a page table.

Inputs have ``page_id`` and ``html``; outputs have one row per token or
element. All work stays inside the page's row, so none of these shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from coursemill.functions import markup
from coursemill.functions.columns import fresh, let


def html_tokens(pages: DataFrame) -> DataFrame:
    """Token table ``(page_id, pos, kind, tag, raw)``."""
    return (
        pages.selectExpr("page_id", f"posexplode({markup.tokens('html')}) AS (pos, raw)")
        .selectExpr("page_id", "CAST(pos AS BIGINT) AS pos", f"{markup.tag_name('raw')} AS tag", "raw")
        .selectExpr("page_id", "pos", f"{markup.token_kind('raw', 'tag')} AS kind", "tag", "raw")
    )


def text_nodes(pages: DataFrame) -> DataFrame:
    """Decoded, stripped text nodes ``(page_id, ord, text)`` outside scripts."""
    texts = f"({markup.document('html', clean=False)}).texts"
    return pages.selectExpr("page_id", f"posexplode({texts}) AS (pos, text)").selectExpr(
        "page_id", "CAST(pos AS BIGINT) AS ord", "text"
    )


def elements(pages: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Element spans ``(page_id, pos, tag, stop, text, raw)``."""
    e = fresh("e")
    tags = tags or markup.TRACKED_TAGS

    def rows(doc: str) -> str:
        return f"""transform({markup.elements_of(doc, tags)}, {e} -> named_struct(
            'pos', CAST({e}.pos AS BIGINT), 'tag', {e}.tag, 'stop', CAST({e}.stop AS BIGINT),
            'text', {markup.element_text(doc, e)}, 'raw', {e}.raw))"""

    return pages.selectExpr("page_id", f"inline({let(markup.document('html', False), rows)})")


def tag_attributes(pages: DataFrame, names: list[str]) -> DataFrame:
    """Attribute values ``(page_id, pos, tag, <names>)`` of every start tag."""
    starts = html_tokens(pages).where("kind IN ('open', 'void')")
    return starts.selectExpr(
        "page_id", "pos", "tag", *[f"{markup.attribute('raw', n)} AS `{n.replace('-', '_')}`" for n in names]
    )
