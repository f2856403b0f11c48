"""Pages to entry rows.

A rule set describes one page layout: where cards are, where the fields of a
card are, and which checks a card has to pass. It holds patterns and column
expressions, no Python that runs per row. It is tied to its layout; arbitrary
selectors are not supported.

Each step of a card's fields goes through a generator of one row, which Spark's optimizer does not look through, so nothing that a later step uses
more than once is computed again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html, keys, links
from ..schema import ENTRY_COLUMNS
from .ingest import dedup_batch

OK = "ok"
HREF = r"(?i)^[^>]*?\shref\s*=\s*[^\s>]"

Expression = Callable[[], Column]


@dataclass(frozen=True)
class Nesting:
    """Cards told by depth: elements ``name`` at ``path`` below the element with the id ``root``, child by child.

    Without ``path`` any such element below the root is a card, if it is in no other. The tags in a
    card know whether they are children of a ``child_of`` and whether they stand in a ``within``.
    """

    root: str
    path: tuple[str, ...] | None
    name: str
    child_of: str
    within: str


@dataclass(frozen=True)
class RuleSet:
    """How to read one layout.

    With ``nesting`` a card is the array ``tags`` of the tags in an element, as ``html.nested_tags`` gives them; one
    whose own tag has no ``href`` is no card. Else ``card`` holds patterns of the opening and the closing tag of a card. The page is cut once at
    each opening tag, so that extraction is linear in
    the page; a piece that is not closed before the next opening tag, or that has no ``href``, is no card. Without
    both the whole page is one card. ``steps``
    and then ``values`` are computed in order from ``url``, ``card`` or ``tags`` and what
    stands before them. ``fragments`` are pieces of HTML whose text is the
    field, or the field's default if the piece is empty; a check can see the
    piece as ``<field>_html``. ``checks`` name the condition under which a card
    is rejected; the first that holds is its status.
    """

    name: str
    nesting: Nesting | None = None
    card: tuple[str, str] | None = None
    steps: tuple[dict[str, Expression], ...] = ()
    fragments: dict[str, Expression] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    values: dict[str, Expression] = field(default_factory=dict)
    checks: list[tuple[str, Expression]] = field(default_factory=list)


def _bound(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with columns that are computed once, whatever is done with them later."""
    if not columns:
        return rows
    return rows.select("*", F.inline(F.array(F.struct(*(column.alias(name) for name, column in columns.items())))))


def _nested_cards(pages: DataFrame, nesting: Nesting) -> DataFrame:
    found = _bound(pages, {"_page": html.tags_from(F.col("html"), nesting.root)}).drop("html")
    inside = html.nested_tags(F.col("_page"), nesting.path, nesting.name, nesting.child_of, nesting.within)
    flat = _bound(found, {"_tags": inside}).drop("_page")
    starts = F.filter(F.transform("_tags", lambda t, i: F.when(t["starts"], i)), lambda i: i.isNotNull())
    placed = _bound(flat, {"_starts": starts})
    stop = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_tags"))
    pieces = F.transform("_starts", lambda s, k: F.slice("_tags", s + 1, stop(k) - s))
    with_target = F.filter(pieces, lambda p: p[0]["html"].rlike(HREF))
    return placed.select("page_id", "url", F.posexplode(with_target).alias("pos", "tags"))


def page_cards(pages: DataFrame, rules: RuleSet, max_per_page: int | None = None) -> DataFrame:
    """``(page_id, url, pos, card)``, with ``tags`` for ``card`` if told by depth; ``pos`` counts from 0 in page order."""
    pages, body = pages.filter(F.col("html").isNotNull()), F.col("html")
    if rules.nesting is not None:
        cards = _nested_cards(pages.select("page_id", "url", "html"), rules.nesting)
    elif rules.card is None:
        return pages.select("page_id", "url", F.lit(0).alias("pos"), body.alias("card"))
    else:
        opening, closing = rules.card
        pieces = F.split(body, opening)
        pieces = F.filter(F.slice(pieces, 2, F.size(pieces)), lambda p: p.rlike(closing) & p.rlike(HREF))
        cut = F.transform(pieces, lambda p: F.concat(F.lit("<a"), F.element_at(F.split(p, closing, 2), 1), F.lit("</a>")))
        cards = pages.select("page_id", "url", F.posexplode(cut).alias("pos", "card"))
    return cards if max_per_page is None else cards.filter(F.col("pos") < max_per_page)


def card_fields(cards: DataFrame, rules: RuleSet) -> DataFrame:
    """The cards with ``title content source link status`` next to them."""
    out = cards
    for step in rules.steps:
        out = _bound(out, {name: expression() for name, expression in step.items()})
    out = _bound(out, {f"{name}_html": expression() for name, expression in rules.fragments.items()})
    out = out.withColumns({f"{name}_text": html.strip_tags(F.col(f"{name}_html")) for name in rules.fragments})
    for name in rules.fragments:
        default = F.when(F.col(f"{name}_html") == "", rules.defaults.get(name, ""))
        out = out.withColumn(name, default.otherwise(html.decode_entities(F.col(f"{name}_text"))))
    for name, expression in rules.values.items():
        out = out.withColumn(name, expression())
    status = F.lit(OK)
    for name, failed in reversed(rules.checks):
        status = F.when(failed(), name).otherwise(status)
    return out.withColumn("status", status).select(
        *cards.columns, "title", "content", "source", "link", "status"
    )


def rejected_cards(fields: DataFrame) -> DataFrame:
    """Where the cards left out of the entries stand, and the reason."""
    return fields.filter(F.col("status") != OK).select("page_id", "url", "pos", "status")


def dated(fields: DataFrame, date_scraped: Column | str) -> DataFrame:
    """The cards with status ``no_date`` where they pass all checks but have no date."""
    missing = (F.col("status") == OK) & keys.as_date_string(date_scraped).isNull()
    return fields.withColumn("status", F.when(missing, "no_date").otherwise(F.col("status")))


def page_entries(fields: DataFrame, date_scraped: Column | str, created_at: Column | str) -> DataFrame:
    """Accepted cards as entries, stamped with the times of the run.

    Keeps ``page_id`` and ``pos`` next to the entry columns; they order copies
    of a card within a batch, whose ``id`` and times are equal. Cards without a date are
    left out; ``dated`` names them.
    """
    stamp = F.lit(created_at) if isinstance(created_at, str) else created_at
    return (
        fields.filter(F.col("status") == OK)
        .withColumn("date_scraped", keys.as_date_string(date_scraped))
        .withColumn("created_at", stamp.cast("timestamp_ntz"))
        .filter(F.col("date_scraped").isNotNull())
        .withColumn("id", keys.entry_id(F.col("title"), F.col("source"), F.col("date_scraped")))
        .select("page_id", "pos", *ENTRY_COLUMNS)
    )


def dedup_page_entries(entries: DataFrame) -> DataFrame:
    """One entry per key, the first in page order."""
    return dedup_batch(entries, order=["page_id", "pos"]).select(ENTRY_COLUMNS)


def link_status(href: Column) -> Column:
    return F.when(links.has_query(href), OK).otherwise("href_without_query")


def extract_stats(rows: DataFrame) -> DataFrame:
    """Rows per ``host`` and ``status``: what was dropped, and where."""
    return rows.groupBy("host", "status").agg(F.count(F.lit(1)).alias("n"))


# Result pages: a card is a link around two blocks, a header and a body.

UNKNOWN_TITLE = "Unknown Title"
FOUND = "<found>"  # a tag in front of what was found, so that an empty element is not a missing one
CARD_OPEN, CARD_CLOSE = r"(?i)<a(?=\s)", r"(?i)</a\s*>"
RESULT_PATH = ("div", "div", "a")


def _places(wanted: Callable[[Column, Column], Column]) -> Column:
    """Where in the card the opening tags stand for which the condition holds, in order."""
    return F.filter(F.transform("tags", lambda t, i: F.when(t["opens"] & wanted(t, i), i)), lambda i: i.isNotNull())


def _end(place: str) -> Column:
    """Where the element ends that opens at a place: before the first later tag of its depth or less."""
    depth = F.get("tags", F.col(place))["depth"]
    later = F.transform(F.slice("tags", F.col(place) + 2, F.size("tags")), lambda t: t["depth"] <= depth)
    ahead = F.array_position(later, True)
    return F.when(F.col(place).isNotNull(), F.when(ahead > 0, F.col(place) + ahead.cast("int")).otherwise(F.size("tags")))


def _piece(start: str, end: str) -> Column:
    tags = F.slice("tags", F.col(start) + 1, F.greatest(F.col(end) - F.col(start), F.lit(0)))
    return F.array_join(F.transform(tags, lambda t: t["html"]), "")


def _found(start: str, end: str) -> Column:
    return F.when(F.col(start).isNotNull(), F.concat(F.lit(FOUND), _piece(start, end))).otherwise("")


def _of_class(name: str) -> Callable[[Column], Column]:
    pattern = rf'(?i)^<div\b[^>]*\bclass\s*=\s*"[^"]*(?<![\w-]){re.escape(name)}(?![\w-])'
    return lambda tag: tag["html"].rlike(pattern)


def results_cards(body_class: str | None = None, root: str = "main", path: tuple[str, ...] | None = RESULT_PATH) -> RuleSet:
    """Rules for result pages.

    Cards are links at ``path`` below the root. Their first child is the header and the second one
    the body. Where the layout marks bodies by a class instead, ``body_class`` names it; the header is then all before, and
    links count wherever they stand below the root.

    The title is the first block within a headline of the header, the source the last block of the header that is a child
    of a block, the content the text of the element around the body's first span, without that span.
    """
    marked = _of_class(body_class) if body_class else None
    in_header = lambda i: (i > F.col("head")) & (i < F.coalesce("body", F.size("tags")))
    in_body = lambda i: (i > F.col("body")) & (i < F.col("body_end"))
    is_div = lambda t: t["name"] == "div"
    depth_at = lambda place: F.get("tags", F.col(place))["depth"]
    first = lambda places: F.get(places, F.lit(0))
    last = lambda places: F.get(places, F.size(places) - 1)
    return RuleSet(
        name="results_cards",
        nesting=Nesting(root, None if body_class else path, "a", "div", "h3"),
        steps=(
            {
                "href": lambda: html.attribute(F.get("tags", F.lit(0))["html"], "href"),
                "children": lambda: _places(lambda t, i: t["depth"] == 1),
            },
            {
                "head": lambda: F.lit(0) if marked else F.get("children", F.lit(0)),
                "body": lambda: first(_places(lambda t, i: marked(t))) if marked else F.get("children", F.lit(1)),
            },
            {
                "body_end": lambda: _end("body"),
                "sources": lambda: _places(lambda t, i: in_header(i) & is_div(t) & t["child"]),
                "titles": lambda: _places(lambda t, i: in_header(i) & is_div(t) & t["within"]),
            },
            {
                "span": lambda: first(_places(lambda t, i: in_body(i) & (t["name"] == "span"))),
                "source_at": lambda: last(F.col("sources")),
                "title_at": lambda: first(F.col("titles")),
            },
            {
                "arounds": lambda: _places(lambda t, i: (i < F.col("span")) & (t["depth"] == depth_at("span") - 1)),
                "span_end": lambda: _end("span"),
                "source_end": lambda: _end("source_at"),
                "title_end": lambda: _end("title_at"),
            },
            {"around": lambda: last(F.col("arounds"))},
            {"around_end": lambda: _end("around")},
        ),
        fragments={
            "title": lambda: _found("title_at", "title_end"),
            "source": lambda: _found("source_at", "source_end"),
            "content": lambda: F.coalesce(F.concat(_piece("around", "span"), _piece("span_end", "around_end")), F.lit("")),
        },
        defaults={"title": UNKNOWN_TITLE},
        values={"link": lambda: links.redirect_target(F.col("href"))},
        checks=[
            ("href_without_query", lambda: ~links.has_query(F.col("href"))),
            ("no_children", lambda: F.size("children") == 0),
            ("no_source", lambda: F.col("source_html") == ""),
            ("no_body", lambda: F.col("body").isNull()),
            ("no_snippet", lambda: F.col("span").isNull()),
        ],
    )


RESULTS_CARDS = results_cards()

# Article pages: the page itself is the card, from its first heading on.

HEADING_OPEN, HEADING_CLOSE = r"(?i)<h1\b", r"(?i)</h1\s*>"
ARTICLE_OPEN = r"(?i)<article\b"
PARAGRAPH_OPEN, PARAGRAPH_CLOSE = r"(?i)<p\b", r"(?i)</p\s*>"


def _after(text: Column, pattern: str) -> Column:
    return F.coalesce(F.get(F.split(text, pattern, 2), F.lit(1)), F.lit(""))


def _inside(text: Column, opening: str, closing: str) -> Column:
    """The first element up to the next closing tag; empty if there is none."""

    def content(pieces: Column) -> Column:
        own = F.concat(F.lit(FOUND), _after(pieces[0], ">"))
        return F.when(F.size(pieces) > 1, own).otherwise("")

    return html.let(F.split(_after(text, opening), closing, 2), content)


def _first_paragraph() -> Column:
    return _inside(_after(F.col("card"), ARTICLE_OPEN), PARAGRAPH_OPEN, PARAGRAPH_CLOSE)


ARTICLE_PAGE = RuleSet(
    name="article_page",
    fragments={
        "title": lambda: _inside(F.col("card"), HEADING_OPEN, HEADING_CLOSE),
        "content": _first_paragraph,
    },
    defaults={"title": UNKNOWN_TITLE},
    values={
        "link": lambda: F.coalesce("url", F.lit("")),
        "source": lambda: links.host(F.col("link")),
    },
    checks=[("no_source", lambda: F.col("source") == "")],
)

# Every link of a page, whatever the layout.
PAGE_LINKS = RuleSet(name="page_links", card=(CARD_OPEN, CARD_CLOSE))


def page_links(pages: DataFrame, max_per_page: int | None = None) -> DataFrame:
    """``(page_id, pos, href)`` of every link with a target."""
    cards = page_cards(pages, PAGE_LINKS, max_per_page)
    return cards.select("page_id", "pos", html.attribute(F.col("card"), "href").alias("href"))
