"""Language identification, centroid clustering and hard negatives against brute force, with edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardmill.llm import cross_parsing, hard_negatives, orchard
from cardmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
RNG = np.random.default_rng(5)


def phrases(text, sample):
    """Greedy longest matches, by searching the sample."""
    n = at = 0
    while at < len(text):
        stop = at + 1
        while stop < len(text) and text[at : stop + 1] in sample:
            stop += 1
        at, n = stop, n + 1
    return n


class TestCrossParsing:
    SAMPLES = {"aa": b"the cat sat on the mat and that was that", "bb": "été à la plage où il était né".encode(), "cc": b"x"}

    def automata(self):
        return [cross_parsing.build_automaton(k, v) for k, v in self.SAMPLES.items()]

    def test_phrases_as_by_searching_the_sample(self, monkeypatch):
        monkeypatch.setattr(cross_parsing, "SEGMENT", 16)
        texts = ["", "a", "x", "the", "the cat was that mat", "où était la plage", "zzz qqq", "漢字", "THE  Cat!!sat\n1on2", "xxxx", "ab" * 40]
        folded = [cross_parsing.folded(t) for t in texts]
        found = cross_parsing.entropies(folded, self.automata())
        for i, text in enumerate(folded):
            data = text.tobytes()
            for j, sample in enumerate(self.SAMPLES.values()):
                n = sum(phrases(data[k : k + 16], sample) for k in range(0, len(data), 16))
                assert found[i, j] == pytest.approx(n * max(8, np.log2(len(sample) + 1)) / max(1, len(data))), (texts[i], j)

    def test_random_texts(self):
        sample = RNG.choice(list(b"abc "), 300).astype(np.uint8).tobytes()
        automaton = cross_parsing.build_automaton("r", sample)
        texts = [RNG.choice(list(b"abcd "), n).astype(np.uint8) for n in (1, 7, 511, 512, 513, 1500)]
        found = cross_parsing.entropies(texts, [automaton])[:, 0]
        for text, bits in zip(texts, found):
            data = text.tobytes()
            n = sum(phrases(data[k : k + 512], sample) for k in range(0, len(data), 512))
            assert bits == pytest.approx(n * np.log2(301) / len(data))

    def test_folding(self):
        assert cross_parsing.folded("  Ab,,c 1É\n").tobytes() == "ab c é".encode()
        assert len(cross_parsing.folded("12 34")) <= 1 and len(cross_parsing.folded("")) == 0

    def test_whole_texts_count(self, spark):
        docs = spark.createDataFrame([(1, "the cat " * 3), (2, "the cat " * 3 + "la plage où il était né " * 400)], "doc_id long, text string")
        rows = cross_parsing.identify_languages(docs, self.automata()).orderBy("doc_id").collect()
        assert [r["language"]["lang"] for r in rows] == ["aa", "bb"]

    def test_edges(self, spark):
        rows = [(1, "the mat", "x"), (1, "the mat", "x"), (None, None, "y"), (2, "", None), (3, " 12 !?", "z"), (4, "漢字", "z"), (5, "that " * 50_000, "w")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"bits": F.lit(1), "SCORE": F.lit(2)})
        found = cross_parsing.identify_languages(docs, self.automata()).orderBy(F.asc_nulls_first("doc_id"), "text").collect()
        assert [r["language"]["lang"] for r in found] == ["und", "aa", "aa", "und", "und", "aa", "aa"]
        assert all(0 <= r["language"]["score"] <= 1 for r in found)
        assert found[0]["lang"] == "y" and found[0]["bits"] == 1
        nothing = cross_parsing.identify_languages(docs, []).collect()
        assert {(r["language"]["lang"], r["language"]["score"]) for r in nothing} == {("und", 0.0)}
        assert cross_parsing.identify_languages(docs.limit(0), self.automata()).collect() == []
        with pytest.raises(ValueError):
            cross_parsing.identify_languages(docs, [], name="Bits")

    def test_learning_takes_copies_once(self, spark):
        own = ["".join(map(chr, RNG.integers(97, 105, 40))) for _ in range(30)]
        rows = [(t, "en") for t in own] + [("copied " * 20, "en")] * 500 + [("mot", "fr"), (None, "fr"), ("1 2", "xx"), ("word", None)]
        docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
        automata = cross_parsing.learn_languages(docs, n_pieces=16, piece_chars=30)
        assert [a.lang for a in automata] == ["en", "fr"]
        assert automata[0].size <= 16 * 31 and automata[1].size == 3
        again = cross_parsing.learn_languages(docs.repartition(2), n_pieces=16, piece_chars=30)
        assert [np.array_equal(a.byte, b.byte) for a, b in zip(automata, again)] == [True, True]
        assert cross_parsing.learn_languages(docs.limit(0)) == []
        assert [a.lang for a in cross_parsing.learn_languages(docs, most_languages=1)] == ["en"]

    def test_held_out_accuracy(self, spark):
        found = QUERIES["op11_cross_parsing"](spark, SF).collect()
        docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
        assert {r["doc_id"] for r in found} == docs.keys() and len(found) == len(docs)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
        kept = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found if r["held_out"]]
        assert len(kept) > 250 and sum(kept) >= 0.98 * len(kept)


class TestOrchard:
    @pytest.mark.parametrize("spread", [0, 1, 5, 1000])
    def test_search_as_by_all_distances(self, spread):
        centroids = RNG.integers(-1000, 1000, (23, 5))
        centroids[7] = centroids[3]
        vectors = np.concatenate([centroids[RNG.integers(0, 23, 300)] + RNG.integers(-spread, spread + 1, (300, 5)), (centroids[:22] + centroids[1:]) // 2])
        best, distance, compared = orchard.nearest_centroids(vectors, orchard.Centroids.of(centroids))
        d = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
        assert np.array_equal(best, d.argmin(1)) and np.array_equal(distance, d.min(1))
        assert compared.max() <= 23 and (spread > 5 or compared.mean() < 20)

    def test_ties_go_to_the_smaller_number(self):
        centroids = np.array([[9, 9], [2, 0], [-2, 0], [0, 2], [0, -2]])
        best, distance, _ = orchard.nearest_centroids(np.array([[0, 0], [1, 1], [-1, -1]]), orchard.Centroids.of(centroids))
        assert best.tolist() == [1, 1, 2] and distance.tolist() == [4, 2, 2]

    def rows(self, df, **options):
        return orchard.with_inertia(*orchard.cluster_vectors(df, **{"size": 2, "scale": 1, **options})).collect()

    def test_edges(self, spark):
        good = [(i, [float(i % 7), float(i % 3) - 1]) for i in range(40)]
        bad = [(50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [1.0, float("nan")]), (55, [float("inf"), 1.0])]
        named = [(None, [3.0, 3.0]), (5, [5.0, 1.0]), (5, [5.0, 1.0])]
        df = spark.createDataFrame(good + bad + named, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "total": F.lit(1)})
        rows = self.rows(df, k=4)
        assert len(rows) == 43 and {r["cluster"] for r in rows} <= {0, 1, 2, 3}
        assert sum(r["vec_id"] == 5 for r in rows) == 3 and sum(r["vec_id"] is None for r in rows) == 1
        whole = sum(r["distance"] for r in rows)
        assert all(r["inertia"] == whole for r in rows)
        for c in {r["cluster"] for r in rows}:
            own = [r for r in rows if r["cluster"] == c]
            assert {r["cluster_inertia"] for r in own} == {sum(r["distance"] for r in own)} and len({r["centroid_sha256"] for r in own}) == 1

    def test_few_and_no_vectors(self, spark):
        schema = "vec_id long, embedding array<double>"
        rows = self.rows(spark.createDataFrame([(1, [1.0, 1.0]), (2, [-1.5, 0.0])], schema))
        assert sorted(r["distance"] for r in rows) == [0, 0]
        assert self.rows(spark.createDataFrame([], schema)) == []
        assert self.rows(spark.createDataFrame([(None, [1.0, 1.0])], schema)) == []

    def test_large_components_are_refused(self, spark):
        df = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            self.rows(df)


def brute(rows, every=10, most=5, scale=256):
    rows = list(dict.fromkeys((i, tuple(v), l) for i, v, l in rows if v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v)))
    points = [[int(np.floor(x * scale)) for x in v] for _, v, _ in rows]
    out = []
    for a, (i, _, label) in enumerate(rows):
        if i is None or i % every:
            continue
        score = [sum(x * y for x, y in zip(points[a], p)) for p in points]
        order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-score[b], rows[b][0] is None, rows[b][0] or 0))
        for p in [b for b in order if rows[b][2] == label][:most]:
            inside = [b for b in order if rows[b][2] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]]
            out += [(i, rows[p][0], at, rows[b][0], score[p], score[b]) for at, b in enumerate(inside[:most], 1)]
    return sorted(out, key=str)


class TestHardNegatives:
    SCHEMA = "vec_id long, embedding array<double>, label int"

    def found(self, spark, rows, **options):
        df = spark.createDataFrame(rows, self.SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("row", "Block", "score", "anchor")})
        return sorted(map(tuple, hard_negatives.hard_negatives(df, every=10, **options).collect()), key=str)

    @pytest.mark.parametrize("low", [-50, 0, 90])
    def test_pairs_as_by_all_products(self, low):
        a, y = RNG.normal(0, 10, (40, 21)).round().astype(np.int64), RNG.normal(0, 10, (300, 21)).round().astype(np.int64)
        y[::3] //= 8
        lows = np.full(40, low * 20) + RNG.integers(0, 400, 40)
        mask = RNG.random((40, 300)) < 0.7
        i, j, score = hard_negatives.threshold_pairs(a, y, lows, lambda start, stop: mask[start:stop].copy())
        products = a @ y.T
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(mask & (products >= lows[:, None]))))
        assert np.array_equal(score, products[i, j])

    def test_index_leaves_out_what_norms_cover(self):
        points = np.array([[1, 0, 0, 9], [9, 0, 0, 1], [1, 0, 0, 1]])
        edges = np.array([0, 2, 4])
        postings, begins = hard_negatives._index(points, hard_negatives._prefix_norms(points.astype(float), edges), edges, 5.0)
        assert begins.tolist() == [1, 0, 2] and [rows.tolist() for rows, _ in postings] == [[1], [0, 1]]

    def test_large_products_are_exact(self):
        a, y = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 7]])
        assert hard_negatives.threshold_pairs(a, y, np.array([1]), lambda s, t: np.ones((1, 1), bool))[2].tolist() == [(1 << 60) + (1 << 30) + 21]
        with pytest.raises(ValueError):
            hard_negatives.threshold_pairs(a << 4, y << 4, np.array([1]), lambda s, t: np.ones((1, 1), bool))

    def test_as_by_brute_force(self, spark, monkeypatch):
        monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", 300)
        monkeypatch.setattr(hard_negatives, "PACK_CELLS", 30)
        centres = RNG.normal(0, 1, (4, 6))
        rows = [(i, (centres[i % 4] + RNG.normal(0, 0.7, 6)).tolist(), int(RNG.integers(0, 3))) for i in range(200)]
        expected = brute(rows)
        assert len(expected) > 100 and self.found(spark, rows) == expected

    def test_ties_repeats_and_lengths(self, spark):
        rows = [(i, [1.0, 0.5], i % 2) for i in range(25)] + [(i, [1.0], 2) for i in range(25, 40)] + [(20, [1.0, 0.5], 0)] * 3
        rows += [(20, [0.9, 0.5], 0), (None, [1.0, 0.5], 1), (None, [1.0, 0.5], 0), (60, [], 1), (61, [], 0), (70, [0.0, 0.0], 0), (80, [-1.0, -1.0], 1)]
        rows += [(90, None, 1), (100, [1.0, None], 1), (110, [float("nan"), 1.0], 1), (120, [1.0, 1.0], None)]
        assert self.found(spark, rows) == brute(rows)

    def test_few_and_no_rows(self, spark):
        assert self.found(spark, []) == []
        assert self.found(spark, [(10, [1.0], 1)]) == []
        assert self.found(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2)]) == [(10, 11, 1, 12, 65536, 58880)]
