"""The trigram index: what patterns must hold, and searches that equal the scan's."""

import random

import pytest
from pyspark.sql import functions as F

from cardmill.functions import trigrams
from cardmill.operators import search
from cardmill.plans import stored
from cardmill.sources.entries import append_entries, index_entries, read_entries
from cardmill.sources.trigrams import dates_holding, read_index

LAST = "2024-01-30"


@pytest.mark.parametrize(
    "pattern,runs",
    [
        ("school", ["school"]),
        ("^the end$", ["the end"]),
        ("abc.def", ["abc", "def"]),
        ("abcd?e", ["abc", "e"]),
        ("abcd*", ["abc"]),
        ("abc+def", ["abc", "def"]),
        ("ab{0}cd", ["a"]),
        ("a|bcd", []),
        ("(a|b)cde", []),
        ("abc(de)?fgh", ["abc"]),
        ("abc[x|y]", []),
        ("abc[xy]def", ["abc"]),
        (r"a\.b\dcd", ["a.b", "cd"]),
        ("abc\\u0041bc", ["abc"]),
        (r"\Qabc\E", []),
        (r"abc\p{L}def", ["abc"]),
        ("(?x)a b c", []),
        ("x" * 3, ["xxx"]),
        ("abc\\", ["abc"]),
    ],
)
def test_runs(pattern, runs):
    assert trigrams.required_runs(pattern) == runs


def test_trigrams_of_both_sides(spark):
    texts = ["École ÉCOLE", "İstanbul ΣΑΣ ſtraße", None, "", "ab", "a-b c1D2", "Дом", "Kelvin", "😀abc😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trigrams.trigrams(F.col("t")))
    for text, found in df.collect():
        assert sorted(found) == trigrams.required_trigrams((text or "").replace("😀", ".")), text


@pytest.fixture(scope="module")
def indexed(spark, snippets, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indexed") / "entries")
    append_entries(snippets.filter("cast(id as bigint) % 3 = 0"), path)
    index_entries(spark, path)
    index_entries(spark, path)
    append_entries(snippets.filter("cast(id as bigint) % 3 > 0"), path)
    return path


def test_search_equals_the_scan(spark, snippets, indexed):
    rng = random.Random(8)
    titles = [r.title for r in snippets.filter("length(title) > 20").orderBy("id").limit(200).collect()]
    patterns = ["the", "ÉLE", "éle", "no such words", "zqx", "", "^th", "a|b", "(x)", "[a-z]{3}", "e+", "th?e", "."]
    for _ in range(25):
        title = rng.choice(titles)
        start = rng.randrange(len(title) - 8)
        piece = "".join("\\" + c if c in "|()[]{}.*+?^$\\" else c for c in title[start : start + rng.randrange(3, 9)])
        patterns.append(rng.choice([piece, piece.upper(), piece.lower(), piece + "?", piece[:-1] + ".", f"{piece}.*e", f"({piece})"]))
    for pattern in patterns:
        try:
            expected = sorted(search.search(snippets, pattern).collect(), key=str)
        except Exception:
            continue  # cutting a title can give no pattern
        assert sorted(stored.stored_search(spark, indexed, pattern).collect(), key=str) == expected, pattern


@pytest.mark.parametrize("pattern", ["the", "ÉLE", "no such words", ""])
def test_pages_equal_the_scan(spark, snippets, indexed, pattern):
    for page in (1, 3):
        expected = search.search_page(snippets, pattern, page).collect()
        assert stored.stored_search_page(spark, indexed, LAST, pattern, page).collect() == expected
    assert stored.stored_search_meta(spark, indexed, LAST, pattern).collect() == search.search_meta(snippets, pattern).collect()


def test_a_rare_word_reads_its_folders(spark, make_entries, tmp_path):
    path = str(tmp_path / "entries")
    index_entries(spark, path)
    assert read_index(spark, path) is not None
    days = [f"2024-01-{d:02d}" for d in range(1, 29)]
    rows = [{"date_scraped": d, "title": f"plain words {i}", "content": "of each day"} for d in days for i in range(5)]
    append_entries(make_entries(rows), path)
    append_entries(make_entries([{"date_scraped": "2024-01-09", "content": "Zanzíbar calls"}]), path)
    assert dates_holding(spark, path, trigrams.required_trigrams("zanzíbar")) == ["2024-01-09"]
    files = stored.stored_search(spark, path, "zanzíbar").inputFiles()
    assert files and all("date_scraped=2024-01-09" in f for f in files)
    assert stored.stored_search(spark, path, "zanzíbar").count() == 1
    assert stored.stored_search(spark, path, "no such thing").inputFiles() == []
    assert len(stored.stored_search(spark, path, "(zan)").inputFiles()) >= 28
    assert stored.stored_search_page(spark, path, LAST, "each.day").count() == 30


def test_without_an_index_all_is_scanned(spark, stored_table, snippets):
    assert dates_holding(spark, stored_table, ["the"]) is None
    assert stored.stored_search(spark, stored_table, "ÉLE").count() == search.search(snippets, "ÉLE").count()


def test_the_table_reads_as_before(spark, indexed, snippets):
    assert read_entries(spark, indexed).count() == snippets.count()
