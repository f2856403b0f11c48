"""The golden results page, entities, links and the rule sets."""

import html as python_html
import re
from html.entities import name2codepoint

import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cardmill.functions import html, keys, links
from cardmill.operators import extract

DAY, NOW = "2024-03-05", "2024-03-05 09:00:00"


def card(href, header, body=None):
    body = "" if body is None else f'<div class="card-body">{body}</div>'
    return f'<div><div><a href="{href}">{header}{body}</a></div></div>'


def header(title, source):
    heading = f"<h3><div>{title}</div></h3>" if title else ""
    return f"<div>{heading}<div>{source}</div></div>"


BODY = "<div><div>Some text <span>3 days ago</span> and more</div></div>"
COMPLETE = card("/url?q=https://a.example/1&amp;sa=U", header("Fish &amp; bread", "Paper A"), BODY)
CARDS = [
    COMPLETE,
    card("/url?q=https://b.example/2?id=5&sa=U", header(None, "Paper B"), BODY),
    card("/url?q=https://c.example/3&sa=U", header("No span", "Paper C"), "<div>plain</div>"),
    card("https://d.example/4", header("No query", "Paper D"), BODY),
    card("/url?q=https://e.example/5&sa=U", "only text"),
    card("/url?q=qq=https://f.example/6&sa=U", header("Stripped", "Paper F"), BODY),
    COMPLETE,
    card("/url?q=https://h.example/8&sa=U", header("No body", "Paper H")),
    card("/url?q=https://i.example/9&sa=U", "<div><h3><div>No source</div></h3></div>", BODY),
]
PAGE = f'<html><body><a href="/nav?q=out">out</a><div id="main">{"".join(CARDS)}</div></body></html>'


@pytest.fixture(scope="module")
def fields(spark):
    pages = spark.createDataFrame([(7, "https://results.example/", PAGE)], "page_id long, url string, html string")
    cards = extract.page_cards(pages, extract.RESULTS_CARDS)
    return extract.card_fields(cards, extract.RESULTS_CARDS)


def test_golden_statuses(fields):
    status = {r.pos: r.status for r in fields.collect()}
    assert status == {
        0: "ok",
        1: "ok",
        2: "no_snippet",
        3: "href_without_query",
        4: "no_children",
        5: "ok",
        6: "ok",
        7: "no_body",
        8: "no_source",
    }


def test_golden_fields(fields):
    rows = {r.pos: r for r in fields.collect()}
    assert rows[0].title == "Fish & bread"
    assert rows[0].source == "Paper A"
    assert rows[0].content == "Some text  and more"
    assert rows[0].link == "https://a.example/1"
    assert rows[1].title == "Unknown Title"
    assert rows[1].link == "https://b.example/2"
    assert rows[5].link == "https://f.example/6"


def test_golden_entries(fields):
    entries = extract.page_entries(fields, DAY, NOW)
    assert [r.pos for r in entries.orderBy("pos").collect()] == [0, 1, 5, 6]
    kept = extract.dedup_page_entries(entries).collect()
    assert sorted(r.source for r in kept) == ["Paper A", "Paper B", "Paper F"]
    assert {r.date_scraped for r in kept} == {DAY}
    assert {str(r.created_at) for r in kept} == {NOW}
    assert len({r.id for r in kept}) == 3 and all(len(r.id) == 24 for r in kept)


def test_golden_rejects(fields):
    rejects = extract.rejected_cards(fields)
    assert rejects.columns == ["page_id", "url", "pos", "status"]
    assert sorted(r.pos for r in rejects.collect()) == [2, 3, 4, 7, 8]
    stats = extract.extract_stats(fields.select(links.host(F.col("url")).alias("host"), "status"))
    assert {(r.status, r.n) for r in stats.collect()} >= {("ok", 4), ("no_body", 1)}


def test_max_per_page(spark, fields):
    pages = spark.createDataFrame([(7, "u", PAGE)], "page_id long, url string, html string")
    assert extract.page_cards(pages, extract.RESULTS_CARDS, max_per_page=3).count() == 3


def test_page_without_root_has_no_cards(spark):
    pages = spark.createDataFrame([(7, "u", '<a href="/x?q=1">x</a>')], "page_id long, url string, html string")
    assert extract.page_cards(pages, extract.RESULTS_CARDS).count() == 0
    assert extract.page_links(pages).collect()[0].href == "/x?q=1"


def test_article_defaults(spark):
    rows = [(1, "https://a.example/x", "<p>no heading</p>"), (2, "nowhere", "<h1>t</h1>"), (3, "https://b.example", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = extract.ARTICLE_PAGE
    out = {r.page_id: r for r in extract.card_fields(extract.page_cards(pages, rules), rules).collect()}
    assert (out[1].title, out[1].content, out[1].status) == ("Unknown Title", "", "ok")
    assert out[2].status == "no_source"
    assert out[3].source == "b.example"


def test_entities_are_decoded_once(spark):
    texts = [
        "plain",
        "",
        "a &amp; b &lt;c&gt; &quot;d&quot; &#39;e&#39;",
        "&amp;lt; stays escaped once",
        "&eacute;&Eacute;&nbsp;&copy;&middot;&euro;",
        "&#233;&#xE9;&#x1F600;&#8364;",
        "AT&T; R&D &unknown; &; && &#; &#x; 100%&",
        "&#0;&#xD800;&#x110000;",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.decode_entities(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == {t: python_html.unescape(t) for t in texts}


def test_pages_with_missing_parts_give_no_null_fields(spark):
    rows = [(1, None, "<h1>t</h1>"), (2, "https://a.example", None), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = extract.ARTICLE_PAGE
    out = extract.card_fields(extract.page_cards(pages, rules), rules).collect()
    assert [(r.page_id, r.status) for r in out] == [(1, "no_source")]
    assert extract.page_cards(pages, extract.RESULTS_CARDS).count() == 0
    assert extract.page_links(pages).count() == 0


def read_cards(spark, cards):
    pages = [(i, "u", f'<div id="main">{c}</div>') for i, c in enumerate(cards)]
    rules = extract.RESULTS_CARDS
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return extract.card_fields(extract.page_cards(df, rules), rules).orderBy("page_id").collect()


def test_header_layouts(spark):
    layouts = [
        ("<div><h3>bare</h3><div>S</div></div>", "Unknown Title", "S"),
        ("<div><h3><div></div></h3><div>S</div></div>", "", "S"),
        ("<div><h3><div>T</div></h3><div>S1</div><div>S2</div></div>", "T", "S2"),
        ("<div class='x'><div><h3 class='y'><div><b>T</b> &gt; u</div></h3></div><div>S</div></div>", "T > u", "S"),
        ("<DIV><H3><DIV>T</DIV></H3><DIV><DIV>in</DIV></DIV></DIV>", "T", "in"),
        ("<div><h3><div>T</div></h3><div></div></div>", "T", ""),
    ]
    rows = read_cards(spark, [card("/url?q=https://a.example/", head, BODY) for head, _, _ in layouts])
    assert [(r.title, r.source, r.status) for r in rows] == [(t, s, "ok") for _, t, s in layouts]


def test_body_layouts(spark):
    layouts = [
        ("<div>a<span>x</span>b</div>", "ab"),
        ("<div>out<div>in <span>x</span></div>after</div>", "in "),
        ("<div><img src='i.png'><div>t <b>bold</b> u <span class='d'>x</span> v<br>w</div></div>", "t bold u  vw"),
        ("<div>a<span>x</span>b<span>kept</span>c</div>", "abkeptc"),
        ("<div><span>x</span></div>", ""),
    ]
    rows = read_cards(spark, [card("/url?q=https://a.example/", header("T", "S"), body) for body, _ in layouts])
    assert [(r.content, r.status) for r in rows] == [(content, "ok") for _, content in layouts]


def plain_card(href, head, body=""):
    return f'<div><div><a href="{href}">{head}{body}</a></div></div>'


PLAIN_CARDS = [c.replace('<div class="card-body">', "<div>") for c in CARDS]


def read_page(spark, page, rules=extract.RESULTS_CARDS):
    df = spark.createDataFrame([(7, "https://results.example/", page)], "page_id long, url string, html string")
    return extract.card_fields(extract.page_cards(df, rules), rules).orderBy("pos").drop("tags").collect()


def test_the_golden_page_without_marker_classes(spark, fields):
    page = f'<html><body><a href="/nav?q=out">out</a><div id="main">{"".join(PLAIN_CARDS)}</div></body></html>'
    assert read_page(spark, page) == fields.orderBy("pos").drop("tags").collect()


@pytest.mark.parametrize(
    "before,after",
    [
        ("<div><div><div>", "</div></div></div>"),
        ("<div>", "</div>"),
        ("", ""),
        ("<div><span>", "</span></div>"),
        ("<section><div>", "</div></section>"),
        ("<div><div></div>", "</div>"),
        ("</div><div><div>", "</div></div>"),
        ("<div><div><a href='/u?q=other'>", "</a></div></div>"),
    ],
)
def test_links_elsewhere_are_no_cards(spark, before, after):
    link = f'<a href="/url?q=https://a.example/">{header("T", "S")}{BODY}</a>'
    rows = read_page(spark, f'<div id="main">{before}{link}{after}</div>')
    assert [r.source for r in rows if r.link == "https://a.example/"] == []


@pytest.mark.parametrize(
    "page",
    [
        '<p>x<DIV class="k" ID = main><div><p>open<div>{}</div></div></DIV>',
        "<div id='main' ><br><img src='x'/><div><input><!-- <div> --><div>{}<b></div></div></div>",
        '<div id="main"><script>if (a < b) "<div>"</script><div><div/><div></p></span>{}</div></div>',
        '<div id="main"><div><div>{}',
        '<div id="mainly"><div><div><a href="?q=no">x</a></div></div></div><div id="main"><div><i></i><div>{}</div></div></div>',
        '<body><div id="main"><div><div><div></body><div id="main"></div>{}',
    ],
)
def test_depth_is_told_as_a_parser_tells_it(spark, page):
    link = f'<a href="/url?q=https://a.example/">{header("T", "S")}{BODY}</a>'
    rows = read_page(spark, page.format(link))
    expected = [] if "</body>" in page or "<p>open" in page else [("T", "S", "Some text  and more", "ok")]
    assert [(r.title, r.source, r.content, r.status) for r in rows] == expected


def test_children_are_told_by_depth(spark):
    cards = [
        ("<div>head only</div>", "no_source"),
        ("<div><div>S</div></div>", "no_body"),
        ("<div><div>S</div></div><img src='i'><div><span>x</span></div>", "no_snippet"),
        ("<p>one<b>two</b></p><div><span>x</span></div>", "no_source"),
        ("<section><div><div>S</div></div></section><p>c<span>x</span>d</p>", "ok"),
        ("text<div><div>S</div></div>text<div><b>c<span>x<i>y</i></span>d</b>e</div>", "ok"),
        ("<div><div>S</div></div><div>c<span>x", "ok"),
        ("<div><h3><div>T<div>inner</div></div></h3></div><div>c<span>x</span></div>", "ok"),
        ("<h3><div>T</div></h3><div>c<span>x</span></div>", "no_source"),
    ]
    rows = read_page(spark, f'<div id="main">{"".join(plain_card("/u?q=l", c) for c, _ in cards)}</div>')
    assert [r.status for r in rows][:6] == [s for _, s in cards][:6]
    assert [(r.source, r.content) for r in rows][4:6] == [("S", "cd"), ("S", "cd")]
    for text, status in cards[6:]:
        (row,) = read_page(spark, f'<div id="main"><div><div><a href="/u?q=l">{text}')
        assert row.status == status
    (row,) = read_page(spark, f'<div id="main">{plain_card("/u?q=l", cards[7][0])}</div>')
    assert (row.title, row.source, row.content) == ("Tinner", "inner", "c")


def test_many_cards_and_nested_tags(spark):
    cards = "".join(plain_card(f"/u?q={i}", f"<div>{'<b>' * (i % 5)}<div>S{i}</div></div>", f"<div>{i}<span>x</span></div>") for i in range(700))
    rows = read_page(spark, f'<div id="main">{cards}</div>')
    assert [r.pos for r in rows] == list(range(700)) and [r.link for r in rows] == [str(i) for i in range(700)]
    assert {r.status for r in rows if int(r.link) % 5 == 0} == {"ok"} and rows[0].source == "S0" and rows[699].status == "no_source"


def test_each_piece_is_computed_once(spark, plan_of):
    from cardmill.plans import registry

    plan = registry.result_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") < 12 and plan.count("RLIKE") < 16 and len(plan) < 300_000


def test_body_class_is_a_whole_name(spark):
    rules = extract.results_cards("snippet")
    bodies = ['<div class="a snippet b">', '<div id="x" class="snippet">', '<div class="snippets">', '<div class="my-snippet">']
    pages = [
        (i, "u", f'<div id="main"><a href="/u?q=x">{header("T", "S")}{body}<span>1</span>c</div></a></div>')
        for i, body in enumerate(bodies)
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = extract.card_fields(extract.page_cards(df, rules), rules).orderBy("page_id").collect()
    assert [r.status for r in rows] == ["ok", "ok", "no_body", "no_body"]


def test_long_text_does_not_overflow(spark):
    text = "<div>" * 2000 + "x &amp; y " * 50_000 + "</div>" * 2000
    page = f"<article><p>{text}</p></article>"
    rows = spark.createDataFrame([(1, "https://a.example", page)], "page_id long, url string, html string")
    rules = extract.ARTICLE_PAGE
    out = extract.card_fields(extract.page_cards(rows, rules), rules).first()
    assert out.content == "x & y " * 50_000


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(
        st.lists(
            st.sampled_from(["&amp;", "&lt;", "&eacute;", "&#65;", "&#x1F600;", "&", ";", "#", "x", "4", "é", "&nope;", "\n", " "]),
            max_size=12,
        ).map("".join),
        min_size=1,
        max_size=300,
    )
)
def test_entities_in_any_text(spark, texts):
    def decode(match):
        name = match.group(1)
        if name.startswith("#"):
            return python_html.unescape(match.group())
        return chr(name2codepoint[name]) if name in name2codepoint else match.group()

    pattern = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.decode_entities(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == {t: re.sub(pattern, decode, t) for t in texts}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hrefs=st.lists(st.text("q=?&/ax%é", max_size=15), min_size=1, max_size=300))
def test_redirect_target_of_any_href(spark, hrefs):
    df = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", links.redirect_target(F.col("h")))
    for href, target in df.collect():
        assert not target.startswith(("q", "=")) and "&" not in target and "?" not in target
        assert target in href and ("?" in href or target == "")


def test_tags_and_comments_go(spark):
    texts = {
        "a<b>b</b>c<br>": "abc",
        "x<!-- a > b <i> -->y": "xy",
        "x<!-- never closed > y": "x y",
        "x<!---->y<!-- 1 --><!-- 2 -->z": "xyz",
        "1 < 2 and no tag": "1 < 2 and no tag",
        "<p\nclass='a'>t": "t",
        "": "",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.strip_tags(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == texts


def test_redirect_target_follows_the_split_rule(spark):
    targets = {
        "/url?q=https://a/&b=1": "https://a/",
        "/u?": "",
        "/u?q=": "",
        "x?a=1?b=2&c": "a=1",
        "x?qq==q=https://z": "https://z",
        "x?q=a%3Fb%26c&d": "a%3Fb%26c",
    }
    df = spark.createDataFrame([(h,) for h in targets], "h string").select("h", links.redirect_target(F.col("h")))
    assert {r[0]: r[1] for r in df.collect()} == targets
    none = spark.createDataFrame([("/plain",)], "h string")
    assert none.select(links.redirect_target(F.col("h"))).first()[0] == ""


def test_timestamps_in_records(spark):
    df = spark.sql("select timestamp_ntz'2024-01-31 05:00:00' a, timestamp_ntz'2024-01-31 05:00:00.5' b")
    row = df.select(keys.iso_timestamp(F.col("a")), keys.iso_timestamp(F.col("b"))).first()
    assert tuple(row) == ("2024-01-31T05:00:00", "2024-01-31T05:00:00.500000")


def test_any_text_as_the_library_decodes_it(spark):
    texts = [
        "&apos;&NewLine;&lsqb;&nbsp x &ampx &notit; &notin; &#146; &#128 &#x80; &#0 &#13; &#x110000; &#xFDD0; &#x1; &copy2",
        "&&amp;amp;&lt&LT;&AMP", "&#xZ; &#; &x; &Aacute &aacut",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.decode_entities(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == {t: python_html.unescape(t) for t in texts}


def test_what_is_no_tag_stays_and_scripts_go(spark):
    texts = {
        "5 < 6 and <b>x</b> y": "5 < 6 and x y",
        "a<script>var x = '<b>';</script>b<STYLE type='t'>c {}</Style >d": "abd",
        "a <3 b": "a <3 b",
        "x<!doctype html>y<?php z ?>": "xy",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.strip_tags(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == texts


@pytest.mark.parametrize("piece", ["<a ", "<a href='x'>", "<p>", "<article>", "<div>", "<h3><div>", "<!--", "<span", "<script>"])
def test_unclosed_tags_take_linear_time(spark, piece):
    page = '<div id="main"><article><p>' + piece * (1_000_000 // len(piece))
    pages = spark.createDataFrame([(1, "https://a.example", page)], "page_id long, url string, html string")
    for rules in (extract.ARTICLE_PAGE, extract.RESULTS_CARDS):
        start = time.perf_counter()
        extract.card_fields(extract.page_cards(pages, rules), rules).collect()
        assert time.perf_counter() - start < 20  # a quadratic pattern takes many minutes


def test_links_after_the_main_block_and_unquoted_links(spark):
    page = f'<div id="main">{card("/url?q=https://a.example/", header("T", "S"), BODY)}</div><footer><a href="/n?q=x">n</a></footer><a href=/u?q=y>z</a>'
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert extract.page_cards(pages, extract.RESULTS_CARDS).count() == 1
    assert [r.href for r in extract.page_links(pages).collect()] == ["/url?q=https://a.example/", "/n?q=x", "/u?q=y"]
