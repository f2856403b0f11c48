import pytest

from cardmill.operators import feed, search


def test_title_or_content_in_any_case(make_entries):
    table = make_entries(
        [
            {"title": "École", "content": "x"},
            {"title": "x", "content": "une éCOLE"},
            {"title": "x", "content": "y"},
            {"title": "a.b", "content": "line\nschool"},
        ]
    )
    assert search.search(table, "éCOLE").count() == 2
    assert search.search(table, r"a\.b").count() == 1
    assert search.search(table, "^line.school").count() == 0
    assert search.search(table, "").count() == 4


def test_pages_of_the_newest_matches(snippets):
    matches = feed.feed_slice(search.search(snippets, "the"), 0, 100).collect()
    pages = [row for page in (1, 2, 3, 4, 5) for row in search.search_page(snippets, "the", page).collect()]
    assert pages == matches and len(pages) == 100


def test_counts_of_matches(snippets):
    capped = search.search_meta(snippets, "the", 4).first()
    assert (capped.total, capped.pages, capped.has_next) == (100, 4, False)
    exact = search.search_meta(snippets, "the", 1, cap=None).first()
    assert exact.total == search.search(snippets, "the").count() > 100
    assert search.search_meta(snippets, "no such words", 1).first().total == 0


def test_empty_pattern_is_the_feed(snippets):
    assert search.search_page(snippets, "", 2).collect() == feed.feed_page(snippets, 2).collect()
    assert search.search_meta(snippets, "", 2).first() == feed.page_meta(snippets, 2).first()


def test_no_cap(snippets):
    assert search.search_page(snippets, "the", 5, cap=None).count() == 30


def test_bad_page(snippets):
    with pytest.raises(ValueError):
        search.search_page(snippets, "the", 0)
