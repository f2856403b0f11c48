"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import base64
import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cardmill.llm import bpe, chat, components, jaccard, licenses, mixing, nn_descent, pii, quality, token_rollup, warc
from cardmill.llm.queries import VOCABULARY
from cardmill.session import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use for columns of their own.
CLASHING = ("mark", "node", "size", "place", "QUALITY", "Pii", "ids", "copies", "key", "n")


@pytest.fixture(scope="module")
def make(spark):
    def build(rows, clashing=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        return df.withColumns({c: F.lit("x") for c in CLASHING if clashing})

    return build


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


RNG = np.random.default_rng(11)
WORDS = ["".join(map(chr, RNG.integers(97, 123, RNG.integers(2, 9)))) for _ in range(400)]
LONG = " ".join(WORDS)


class TestBpe:
    TEXTS = [None, "", " ", "a", "  two  spaces ", "naïve café ÀÉ", "漢字 と かな", "😀😀 ok", "I'll've 12345 x_1\n\n\tz", "aaaa" * 40,
             "ab" * 700, "x" * 3000, "<|endoftext|>", "\x00\x01 \x7f", LONG]

    def test_same_ids_and_round_trip(self, make, ranks, library):
        encoded = bpe.encode(make(self.TEXTS), ranks, public_tokenizers.PATTERN)
        rows = encoded.select("doc_id", "ids", bpe.decode(F.col("ids"), ranks).alias("data")).collect()
        assert len(rows) == len(self.TEXTS)
        for row in rows:
            text = self.TEXTS[row["doc_id"]] or ""
            assert row["ids"] == library.encode_ordinary(text)
            assert bytes(row["data"]) == text.encode()

    def test_long_words_merge_alike(self, ranks, library):
        for word in ("ab" * 700, "x" * 3000, "thethethe" * 100, "zq" * 300 + "the"):
            assert bpe.merge_long(word.encode(), ranks) == library.encode_ordinary(word)

    def test_repeated_and_unnamed_rows(self, make, ranks):
        rows = bpe.encode(make([(1, "a b"), (1, "a b"), (None, "c"), (None, None)]), ranks, public_tokenizers.PATTERN)
        assert sorted((r["doc_id"] is None, len(r["ids"])) for r in rows.collect()) == [(False, 2), (False, 2), (True, 0), (True, 1)]

    def test_chunks_end_anywhere(self, make, ranks, library, monkeypatch):
        monkeypatch.setattr(bpe, "CHUNK_CHARS", 5)
        rows = bpe.encode(make(self.TEXTS), ranks, public_tokenizers.PATTERN).collect()
        assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode_ordinary(t or "") for i, t in enumerate(self.TEXTS)}

    def test_empty_table(self, make, ranks):
        assert bpe.encode(make([]), ranks, public_tokenizers.PATTERN).collect() == []

    def test_no_chunk_is_gathered_again(self, make, ranks, plan_of):
        """The words of a chunk used to meet in one group, beside its places: the memory of an executor."""
        plan = plan_of(bpe.encode(make(self.TEXTS), ranks, public_tokenizers.PATTERN))
        assert "CoGroup" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1

    def test_nothing_is_written_or_shuffled(self, spark, ranks, library, plan_of, tmp_path):
        spark.createDataFrame([(1, "a b a"), (2, LONG)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
        before = sorted(os.listdir(shared_folder(spark).removeprefix("file:")))
        found = bpe.encode(spark.read.parquet(f"{tmp_path}/docs"), ranks, public_tokenizers.PATTERN)
        assert {r["doc_id"]: r["ids"] for r in found.collect()}[2] == library.encode_ordinary(LONG)
        assert sorted(os.listdir(shared_folder(spark).removeprefix("file:"))) == before
        assert "Exchange" not in plan_of(found)

    def test_words_of_all_lengths_fold_alike(self, ranks, library, monkeypatch):
        monkeypatch.setattr(bpe, "FOLD_CELLS", 300)
        letters = ["a", "e", "th", "x", "é", "漢", "😀", " ", "1"]
        words = ["".join(RNG.choice(letters, n)) for n in range(1, 200)] + WORDS + ["", "ab" * 300]
        flat, starts, sizes = bpe.fold_merges([w.encode() for w in words], ranks, bpe.merges_of(ranks))
        for word, start, size in zip(words, starts, sizes):
            assert flat[start : start + size].tolist() == library._core_bpe.encode_single_piece(word.encode()) if word else size == 0

    def test_lowest_rank_first_then_first_place(self):
        ranks = {bytes((b,)): b for b in range(256)} | {b"bc": 300, b"aa": 301, b"ab": 302, b"abc": 303, b"aab": 299}
        flat, starts, sizes = bpe.fold_merges([b"abcd", b"aaab", b"aaaaa", b"abab"], ranks, bpe.merges_of(ranks))
        found = [flat[start : start + size].tolist() for start, size in zip(starts, sizes)]
        assert found == [[303, 100], [301, 302], [301, 301, 97], [302, 302]]

    def test_bytes_that_the_vocabulary_lacks_have_no_id(self, make):
        rows = bpe.encode(make(["abxab"]), {b"a": 0, b"b": 1, b"ab": 2}, ".+").collect()
        assert rows[0]["ids"] == [2, None, 2]


class TestJaccard:
    def found(self, df):
        return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.shingle_components(df).collect()}

    def test_small_and_missing_texts(self, make):
        found = self.found(make([None, "", " \n", "a", "A", "a b", "b a", "a b c d e", "a  B\nc d E", "a b c d e f", "\xa0", "\xa0"]))
        assert found == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 6), 7: (1, 7), 8: (1, 7), 9: (2, 9), 10: (1, 10), 11: (1, 10)}

    def test_threshold_is_met_exactly(self, make):
        three, four = "a b c d e f g", "a b c d e f g h"  # 3 and 4 shingles: 3/4
        assert self.found(make([four, three, "a b c d e f"])) == {0: (4, 0), 1: (3, 0), 2: (2, 2)}

    def test_chain_and_group_of_copies(self, make):
        chain = [" ".join(WORDS[12 * i : 12 * i + 120]) for i in range(12)]
        rng = np.random.default_rng(1)
        copies = []
        for _ in range(60):
            words = [f"c{i}" for i in range(150)]
            for at in rng.choice(150, 3, replace=False):
                words[at] = f"x{rng.integers(10**6)}"
            copies.append(" ".join(words))
        rows = list(enumerate(chain)) + [(100 + i, c) for i, c in enumerate(copies)] + [(500 + i, copies[7]) for i in range(200)]
        found = self.found(make(rows))
        sets = {i: jaccard.shingle_set(t) for i, t in rows}
        label = {i: i for i in sets}
        ids = sorted(sets)
        for _ in ids:
            before = dict(label)
            for a in ids[:72]:
                for b in ids:
                    if jaccard._linked(sets[a], sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
            if label == before:
                break
        assert {i: c for i, (_, c) in found.items()} == label

    def test_repeated_rows_and_missing_ids(self, make):
        rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "z y x w v u"), (None, "a b c d e f"), (None, "q"), (2, "z y x w v u")]
        found = jaccard.shingle_components(make(rows)).collect()
        assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == [
            ("2", "2"), ("5", "2"), ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
        kept = jaccard.distinct_documents(make(rows))
        assert kept.columns == make(rows).columns
        assert sorted((str(r["doc_id"]), r["text"][0]) for r in kept.collect()) == [("2", "z"), ("5", "a"), ("None", "q")]

    def test_components_with_one_id_keep_a_document_each(self, make):
        first, other = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
        for near in (first, other):
            kept = jaccard.distinct_documents(make([(5, first), (5, other), (9, near + " more")])).collect()
            assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, first), (5, other)])

    def test_empty_table(self, make):
        assert self.found(make([])) == {}
        assert jaccard.distinct_documents(make([])).collect() == []

    @pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 14, 33, 100, 700])
    def test_sets_that_link_share_a_signature(self, n):
        rng = np.random.default_rng(n)
        for _ in range(200):
            a = np.unique(rng.integers(2**63, size=n, dtype=np.uint64))
            k = int(rng.integers(0, n // 3 + 1))
            b = np.unique(np.r_[a[int(rng.integers(0, k + 1)) :], rng.integers(2**63, size=k, dtype=np.uint64)])
            if len(b) and jaccard._linked(a, b):
                assert jaccard._may_link(len(a), len(b), jaccard.sketch(a), jaccard.sketch(b))
                for fine in (False, True):
                    assert len(np.intersect1d(jaccard.signatures(a, fine)[0], jaccard.signatures(b, fine)[0]))

    @pytest.mark.parametrize("bits", [16, 1])
    def test_wanted_documents_are_not_broadcast_one_by_one(self, spark, monkeypatch, bits):
        monkeypatch.setattr(jaccard, "KEY_BITS", bits, raising=False)
        texts = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(20_000)]
        of = [jaccard._node(jaccard.shingle_set(t)) for t in texts]
        rows = [(i, t, n) for i, (t, n) in enumerate(zip(texts, of))]
        docs = spark.createDataFrame(rows, "doc_id long, text string, node long").withColumn("mark", F.xxhash64("text"))
        nodes, wanted = docs.select("node", "doc_id", "mark"), docs.filter("doc_id % 2 = 0").select("node")
        plans, real = [], jaccard.stored
        monkeypatch.setattr(jaccard, "stored", lambda df, *args, **named: plans.append(df) or real(df, *args, **named))
        found = jaccard._sets_of(docs.select("doc_id", "mark", "text").unionByName(docs.limit(9).selectExpr("doc_id", "mark", "null AS text")), wanted, nodes)
        assert sorted(r["node"] for r in found.select("node").collect()) == sorted(of[::2])

        def broadcast(plan) -> int:
            """Rows that the exchanges of an executed plan broadcast."""
            kind = plan.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                return broadcast(plan.executedPlan())
            if kind.endswith("QueryStageExec"):
                return broadcast(plan.plan())
            own = plan.metrics().apply("numOutputRows").value() if kind == "BroadcastExchangeExec" else 0
            return own + sum(broadcast(plan.children().apply(i)) for i in range(plan.children().size()))

        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = plans[-1].groupBy().count()  # planned anew, without size limits of its own
            plan.collect()
            assert 0 < broadcast(plan._jdf.queryExecution().executedPlan()) <= 10
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def test_components_of_a_long_path(self, spark):
        links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(7, 7), (301, 300), (301, 300)], "a long, b long")
        found = {r["node"]: r["root"] for r in components.components(links).collect()}
        assert found == {i: 0 for i in range(201)} | {300: 300, 301: 300}


class TestQuality:
    def test_missing_repeated_and_long_texts(self, make):
        rows = [None, "", "one", LONG, LONG, "spam " * 5000, "ab cd\nab cd\n \n\n ef"]
        found = {r["doc_id"]: r["q"] for r in quality.quality_rules(make(rows), name="q").collect()}
        assert [found[i]["n_words"] for i in range(7)] == [0, 0, 1, 400, 400, 5000, 5]
        assert [found[i]["kept"] for i in range(7)] == [False, False, False, True, True, False, False]
        assert found[5]["n_repeat_words"] == 5000 and found[6]["n_dup_lines"] == 1

    def test_ratio_rejects_what_no_count_does(self, make):
        noise = np.random.default_rng(0)
        letters = " ".join("".join(map(chr, noise.integers(0x4E00, 0x9FFF, 12))) for _ in range(2000))
        found = {r["doc_id"]: r["q"] for r in quality.quality_rules(make([letters, " ".join(f"{i % 7}abcdefgh{i}" for i in range(3000))]), name="q").collect()}
        assert not found[0]["base_failed"] and not found[0]["kept"]
        assert found[0]["ratio"] < 1.4

    def test_empty_table_and_name_taken(self, make):
        assert quality.quality_rules(make([]), name="q").collect() == []
        with pytest.raises(ValueError):
            quality.quality_rules(make([]))


class TestMixing:
    def test_missing_values_and_repeats(self, make):
        rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e", None), (4, "f " * 9, None), (None, None, "y")]
        sized = mixing.sized_documents(make(rows))
        found = mixing.mix_sources(sized).collect()
        assert len(found) == len(rows)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in found)
        assert {r["source"]: r["target"] for r in found} == {"x": 12.0, "y": 0.0, None: 13.5}
        docs = make(rows)
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        assert mixed.count() == sum(r["copies"] for r in found)

    def test_tree_of_buckets_keeps_words(self, spark, monkeypatch):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
        monkeypatch.setattr(mixing, "FAN_IN", 3)
        rows = [(i, "big" if i % 3 else f"s{i % 5}", 1 + i * i % 97, 0) for i in range(500)]
        sized = spark.createDataFrame(rows, "doc_id long, source string, size long, mark long")
        found = mixing.mix_sources(sized).collect()
        assert sorted(r["doc_id"] for r in found) == list(range(500))
        for source in {r["source"] for r in found}:
            own = [r for r in found if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 98

    def test_draws_are_fair(self):
        size, chance = np.array([3.0, 5.0, 2.0, 8.0]), np.array([0.5, 0.25, 0.75, 0.5])
        rng = np.random.default_rng(3)
        total = np.zeros(4)
        for _ in range(8000):
            done, open_ = mixing.settle(size, chance, rng.random(4))
            assert done @ size == pytest.approx(chance @ size)
            assert open_ is None or 0 < done[open_] < 1
            total += done
        assert np.allclose(total / 8000, chance, atol=0.03)

    def test_empty_table(self, make):
        assert mixing.mixed_documents(make([])).collect() == []


class TestPii:
    def spans(self, make, texts):
        found = pii.find_pii(make(texts, clashing=False)).select("doc_id", pii.listed(F.col("pii")).alias("s"))
        return [s for _, s in sorted((r["doc_id"], r["s"]) for r in found.collect())]

    def test_kinds_and_checks(self, make):
        assert self.spans(make, [
            None, "", "a@b", "é😀 a@b.c@d.e-f", "1.2.3.4.5 256.1.1.1 001.02.3.255", "4111 1111-1111 1111, 4111111111111112",
            "+1 (705) 555-5569. +12", "IBAN DE89370400440532013000 GB82 WEST 1234 5698 7654 32 DE00370400440532013000", "a@b.cd_x@y.zz",
        ]) == ["", "", "", "email:3:8", "ip:0:7,ip:20:32", "card:0:19", "phone:0:17", "iban:5:27,iban:28:55", "email:0:6,email:6:13"]

    def test_accounts_end_where_their_numbers_do(self, make):
        es, at = "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201"
        texts = [f"{es} BIC", f"{es} 250 EUR", f"{at} 2024", f"{es} {at}", f"ID12 {es}", f"{es} 12 XY34", f"{es}X", f"{es[:-1]}3 BIC"]
        found = [[x for x in s.split(",") if x.startswith("iban")] for s in self.spans(make, texts)]
        assert found == [["iban:0:29"], ["iban:0:29"], ["iban:0:24"], ["iban:0:29", "iban:30:54"], ["iban:5:34"], ["iban:0:29"], [], []]

    def test_context_raises_the_score(self, make):
        found = pii.find_pii(make(["call +44 2071838750", "see +44 2071838750"], clashing=False)).orderBy("doc_id").collect()
        assert found[0]["pii"][0]["score"] > found[1]["pii"][0]["score"]

    def test_context_on_both_sides_in_the_languages_of_the_corpus(self, make):
        card = "4111 1111 1111 1111"
        texts = [card, f"{card} card", f"Karte {card}", f"{card} tarjeta", f"paiement par {card}", f"card {'x' * 60} {card} {'x' * 60} card"]
        found = pii.find_pii(make(texts, clashing=False)).orderBy("doc_id").collect()
        assert [r["pii"][0]["score"] for r in found] == [0.8, 1.0, 1.0, 1.0, 1.0, 0.8]

    def test_credentials(self, make):
        value = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
        assert self.spans(make, [
            f'x token = "{value}"', f"TOKEN:{value.upper()}.", f'{{"api_key": "{value}"}}', f"my_token={value}", f"tokens = {value}",
            "token = abcdefghijklmnopqrstuvwxyz", "token = 1234567890123456789", "password: short1", f"secret\n= {value}", f"é password='{value}'!",
        ]) == ["secret:2:52", "secret:0:47", "secret:2:54", "secret:3:49", "", "", "", "", "", "secret:2:53"]

    def test_long_runs(self, make):
        texts = ["token=" * 50_000, "a" * 200_000, "1" * 200_000, "1.." * 100_000, "+1" + "-" * 200_000, "A1" * 100_000, "a@" * 100_000, "+" * 200_000]
        assert self.spans(make, texts) == [""] * 8

    def test_redaction(self, make):
        docs = pii.find_pii(make(["😀 mail a@b.co now", "none", None, "+14111111111111 x 1.2.3.4"], clashing=False))
        found = docs.select("doc_id", pii.redacted(F.col("text"), F.col("pii")).alias("t")).orderBy("doc_id").collect()
        assert [r["t"] for r in found] == ["😀 mail [EMAIL] now", "none", None, "[PHONE] x [IP]"]

    def test_empty_table_and_name_taken(self, make):
        assert pii.find_pii(make([], clashing=False)).collect() == []
        with pytest.raises(ValueError):
            pii.find_pii(make([]))


class TestLicenses:
    def test_spread_templates_are_found_at_any_offset(self, make):
        words = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
        spread = words[:8] + [f"n{i}" for i in range(64 - len(words))] + words[8:]
        rows = [" ".join(WORDS[:k] + spread + WORDS[:50]) for k in range(0, 70, 3)]
        rows += [" ".join(WORDS[:k] + words[:8] + [f"n{i}" for i in range(200)] + words[8:]) for k in (0, 31)]
        found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(make(rows)).collect()}
        assert all(found[i] == ["mit"] for i in range(24)) and found[24] == found[25] == []

    def test_phrases_templates_and_missing_texts(self, make):
        rows = [None, "", "CC BY cc-by CC\tBy", "éCC BY", "all rights reserved", "Released\nunder the  MIT License!", LONG, "cc by cc by"]
        found = {r["doc_id"]: r for r in licenses.scan_licenses(make(rows)).collect()}
        get = lambda c: [found[i][c] for i in range(len(rows))]
        assert get("n_words") == [0, 0, 6, 2, 3, 5, 400, 4]
        assert get("n_base") == [0, 0, 3, 0, 1, 0, 0, 2]
        assert get("first_word") == [None, None, 0, None, 0, None, None, 0]
        assert get("last_word") == [None, None, 4, None, 0, None, None, 2]
        assert get("labels") == [[], [], ["cc-by"], [], ["reserved"], ["mit"], [], ["cc-by"]]
        assert get("score") == [0, 0, 1, 0, 1, 1, 0, 1]

    def test_repeats_missing_ids_and_long_text(self, make):
        text = LONG * 60 + " licensed under the Apache License, Version 2.0 " + LONG * 60
        found = licenses.scan_licenses(make([(1, text), (1, text), (None, text), (1, "x")])).collect()
        assert sorted((str(r["doc_id"]), r["labels"]) for r in found) == [("1", []), ("1", ["apache-2.0"]), ("1", ["apache-2.0"]), ("None", ["apache-2.0"])]

    def test_empty_table(self, make):
        assert licenses.scan_licenses(make([])).collect() == []


class TestChat:
    SCHEMA = "conv_id long, turn long, role string, text string, ends string, speaker string"

    def test_every_participant_is_the_assistant_once(self, spark):
        turns = [(1, 0, "system", "s"), (1, 1, "Ann", "hi"), (1, 2, "Bo", None), (1, 2, "Bo", None), (1, 3, None, "é😀"), (2, 0, "system", "x"), (None, None, "Ann", "lost")]
        rows = chat.rotate_perspectives(spark.createDataFrame([(*t, "p", "q") for t in turns], self.SCHEMA)).collect()
        found = {(r["conv_id"], r["speaker"]): r for r in rows}
        assert found.keys() == {(1, "Ann"), (1, "Bo"), (1, "user"), (None, "Ann")}
        ann = found[1, "Ann"]
        assert ann["transcript"] == (
            "<|system|>\ns<|end|>\n<|assistant|>\nhi<|end|>\n<|user|>\nBo: <|end|>\n<|user|>\nBo: <|end|>\n<|user|>\nuser: é😀<|end|>\n")
        for (_, speaker), r in found.items():
            spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",")]
            assert "".join(r["transcript"][a:b] for a, b in spans) == {
                "Ann": "hi<|end|>\n" if r["conv_id"] else "lost<|end|>\n", "Bo": "<|end|>\n" * 2, "user": "é😀<|end|>\n"}[speaker]
            assert r["n_trained"] == sum(b - a for a, b in spans)

    def test_dialogues_are_whole_whatever_their_numbers(self, spark):
        turns = [(1, 0, "system", "s", "p", "q"), (1, 300, "b", "late", "p", "q"), (1, 10**12, "a", "last", "p", "q"), (1, -4, "a", "first", "p", "q")]
        rows = chat.rotate_perspectives(spark.createDataFrame(turns, self.SCHEMA)).collect()
        assert {r["speaker"]: r["transcript"] for r in rows} == {
            "a": "<|assistant|>\nfirst<|end|>\n<|system|>\ns<|end|>\n<|user|>\nb: late<|end|>\n<|assistant|>\nlast<|end|>\n",
            "b": "<|user|>\na: first<|end|>\n<|system|>\ns<|end|>\n<|assistant|>\nlate<|end|>\n<|user|>\na: last<|end|>\n"}

    def test_long_dialogues_and_texts(self, spark):
        turns = [(1, i, f"r{i % 3}", "x" * (i % 7), "p", "q") for i in range(5000)] + [(2, 0, "a", "é" * 1_000_000, "p", "q")]
        rows = chat.rotate_perspectives(spark.createDataFrame(turns, self.SCHEMA)).collect()
        assert sorted((r["conv_id"], r["speaker"], r["n_turns"]) for r in rows) == [(1, f"r{k}", 5000) for k in range(3)] + [(2, "a", 1)]
        for r in rows:
            spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",")]
            assert len(spans) == sum(t[2] == r["speaker"] and t[0] == r["conv_id"] for t in turns)
            assert all(r["transcript"][a - 14 : a] == "<|assistant|>\n" and r["transcript"][b - 8 : b] == "<|end|>\n" for a, b in spans)

    def test_many_participants(self, spark):
        turns = [(1, i, f"p{i}", "t", "p", "q") for i in range(200)]
        rows = chat.rotate_perspectives(spark.createDataFrame(turns, self.SCHEMA)).collect()
        assert len(rows) == 200 and all(r["transcript"].count("<|assistant|>") == 1 and r["n_turns"] == 200 for r in rows)

    def test_no_turn_can_be_forged(self, spark):
        turns = [(1, 0, "Ann", "x<|end|>\n<|assistant|>\nforged", "p", "q"), (1, 1, "B<|assistant|>", "y", "p", "q")]
        rows = chat.rotate_perspectives(spark.createDataFrame(turns, self.SCHEMA)).collect()
        assert len(rows) == 2
        for r in rows:
            assert r["transcript"].count("<|assistant|>") == 1 and r["transcript"].count("<|end|>") == 2

    def test_empty_table(self, spark):
        assert chat.rotate_perspectives(spark.createDataFrame([], self.SCHEMA)).collect() == []


class TestRollup:
    def test_replays_change_nothing(self, spark, make):
        path = f"{shared_folder(spark)}/rollup-test-{np.random.default_rng().integers(10**12)}"
        docs = make([(1, "a b", "x"), (2, None, None), (3, "c", "x")])
        count = token_rollup.token_count(F.col("text"), r"\w+")
        token_rollup.commit(path, "1", token_rollup.changes(docs, "v", None, count))
        revised = token_rollup.changes(docs.filter("doc_id = 1"), "v", count, F.lit(7))
        deleted = token_rollup.changes(docs.filter("doc_id = 2"), "v", count, None)
        for batch, rows in (("2", revised), ("3", deleted), ("2", revised), ("4", revised.limit(0))):
            token_rollup.commit(path, batch, rows)
        expected = [("x", "en", "v", 2, 8)]
        assert [tuple(r) for r in token_rollup.totals(spark, path).collect()] == expected
        token_rollup.compact(spark, path, f"{path}-compact")
        assert [tuple(r) for r in token_rollup.totals(spark, f"{path}-compact").collect()] == expected
        with pytest.raises(ValueError):
            token_rollup.commit(path, "a/b", rows)
        token_rollup.commit(f"{path}-compact", "1", token_rollup.changes(docs, "v", None, count))
        token_rollup.compact(spark, path)
        token_rollup.commit(path, "2", revised)
        for folder in (path, f"{path}-compact"):
            assert [tuple(r) for r in token_rollup.totals(spark, folder).collect()] == expected
            assert sorted(r[0] for r in token_rollup.committed(spark, folder).collect()) == ["1", "2", "3", "4"]
        token_rollup.commit(path, "5", deleted.limit(0).unionByName(token_rollup.changes(docs.filter("doc_id = 3"), "v", None, count)))
        assert [tuple(r) for r in token_rollup.totals(spark, path).collect()] == [("x", "en", "v", 3, 9)]

    def test_a_commit_that_breaks_off_is_not_seen(self, spark, make):
        path = f"{shared_folder(spark)}/rollup-test-{np.random.default_rng().integers(10**12)}"
        assert token_rollup.totals(spark, path).collect() == []
        docs = make([(1, "a b", "x")])
        count = token_rollup.token_count(F.col("text"), r"\w+")
        broken = token_rollup.changes(docs, "v", None, F.when(F.col("doc_id") == 1, F.raise_error(F.lit("lost")).cast("long")))
        for batch in ("1", "1"):
            with pytest.raises(Exception, match="lost"):
                token_rollup.commit(path, batch, broken)
            assert token_rollup.totals(spark, path).collect() == []
        token_rollup.commit(path, "1", token_rollup.changes(docs, "v", None, count))
        with_texts = make([(2, "w " * 100_000, "x"), (3, "q", None)]).withColumn("lang", F.lit(None).cast("string"))
        token_rollup.commit(path, "2", token_rollup.changes(with_texts, "v", None, count))
        found = {(r["source"], r["lang"]): r["n_tokens"] for r in token_rollup.totals(spark, path).collect()}
        assert found == {("x", "en"): 2, ("x", None): 100_000, (None, None): 1}


class TestWarc:
    SCHEMA = "page_id long, url string, html string, digest string, first long"

    def folder(self, spark):
        return f"{shared_folder(spark)}/warc-test-{np.random.default_rng().integers(10**12)}"

    def test_round_trip(self, spark):
        path = self.folder(spark)
        pages = [(3, "u\r\nx", "é\r\n\r\nWARC/1.1\r\n"), (1, None, None), (2, "u", ""), (9, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "p"), (None, "n", "own"), (4, "v", "p"), (4, "v", "p"), (5, "w", "q" * 500_000)]
        df = spark.createDataFrame([(*p, "d", 7) for p in pages], self.SCHEMA).repartition(3)
        warc.write_pages(df, path)
        rows = warc.read_pages(spark, path).collect()
        found = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
        assert found == [("1", "response", None, 0), ("2", "revisit", 1, 0), ("3", "response", None, 16), ("4", "response", None, 1), ("4", "response", None, 1),
                         ("5", "response", None, 500_000), ("9", "revisit", 3, 16), ("None", "response", None, 3), ("None", "revisit", 4, 1)]
        payloads = spark.read.format("warc").load(path).filter("record_type = 'response'").collect()
        assert sorted(bytes(r["payload"]) for r in payloads) == sorted((p[2] or "").encode() for p in pages if p[0] not in (2, 9) and p[:3] != (None, "n", "p"))
        assert all(r["payload_digest"] == warc.payload_digest(bytes(r["payload"])) for r in payloads)

    def test_any_other_reader_finds_the_html(self, spark):
        import gzip
        import glob

        path = self.folder(spark)
        warc.write_pages(spark.createDataFrame([(1, "u", "<p>é</p>", "d", 7)], self.SCHEMA), path)
        (name,) = glob.glob(f"{path.removeprefix('file:')}/*.warc.gz")
        head, http, body = gzip.open(name).read().split(b"\r\n\r\n")[:3]
        digest = hashlib.sha1(body).digest()
        assert body == "<p>é</p>".encode() and b"Content-Encoding" not in http and b"Content-Length: 9" in http
        assert f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}".encode() in head

    def test_archives_of_others(self, spark, tmp_path):
        """Bodies as they were sent, the digest being that of the encoded or of the plain body."""
        import gzip
        import zlib

        html = b"<html>" + b"x" * 50
        raw = zlib.compressobj(wbits=-15)
        chunked = lambda b: b"5;a=b\r\n" + b[:5] + b"\r\n%x\r\n" % (len(b) - 5) + b[5:] + b"\r\n0\r\n\r\n"
        bodies = [("", html), ("Content-Encoding: gzip", gzip.compress(html)), ("Content-Encoding: deflate", zlib.compress(html)),
                  ("Content-Encoding: deflate", raw.compress(html) + raw.flush()), ("Transfer-Encoding: chunked", chunked(html)),
                  ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress(html))), ("Content-Encoding: gzip", html)]
        data = b""
        for i, (header, body) in enumerate(bodies):
            for j, digest in enumerate((f"sha1:{warc.payload_digest(body)}", f"sha1:{warc.payload_digest(html)}", "md5:abc", None)):
                fields = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{10 * i + j}>", "Content-Type": "application/http; msgtype=response"}
                fields |= {"WARC-Payload-Digest": digest} if digest else {}
                data += warc.record(fields, f"HTTP/1.1 200 OK\r\n{header}\r\n\r\n".replace("OK\r\n\r\n\r\n", "OK\r\n\r\n").encode() + body)
        data += warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:i>", "Content-Type": "application/warc-fields"}, b"software: x")
        (tmp_path / "a.warc").write_bytes(data)
        warc.use_warc(spark)
        rows = spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'response'").collect()
        assert len(rows) == 4 * len(bodies) and {bytes(r["payload"]) for r in rows} == {html}

    def test_unwanted_payloads_are_not_decoded(self, spark, tmp_path):
        broken = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Payload-Digest": "sha1:X", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\n\r\nbad")
        good = warc.page_record("urn:page:2", "u", "d", b"fine", None)
        (tmp_path / "a.warc").write_bytes(broken + good)
        import gzip

        (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(broken))
        warc.use_warc(spark)
        reader = spark.read.format("warc")
        one = reader.load(str(tmp_path)).filter("record_id = 'urn:page:2'")
        assert [bytes(r["payload"]) for r in one.collect()] == [b"fine"] * 2
        assert reader.option("payloads", "false").load(str(tmp_path)).filter("record_type IN ('response', 'x')").count() == 4
        with pytest.raises(Exception, match="digest"):
            reader.option("payloads", "true").load(str(tmp_path)).collect()

    def test_empty_table(self, spark):
        path = self.folder(spark)
        warc.write_pages(spark.createDataFrame([], self.SCHEMA), path)
        assert warc.read_pages(spark, path).collect() == []


class TestNearest:
    SCHEMA = "vec_id long, embedding array<float>, node long, vec string"

    def test_classes_ties_and_rows_that_take_no_part(self, spark):
        rng = np.random.default_rng(5)
        rows = [(i, rng.normal(size=8).tolist()) for i in range(30)]
        rows += [(100 + i, [1.0] * 8) for i in range(40)] + [(100, [1.0] * 8)]
        rows += [(200, None), (300, [0.0] * 8), (400, [float("nan")] * 8), (500, [None] + [1.0] * 7), (600, [float("inf")] * 8), (None, [1.0] * 8), (700, [1.0])]
        df = spark.createDataFrame([(*r, 1, "v") for r in rows], self.SCHEMA)
        found = nn_descent.nearest_neighbours(df).orderBy("query_id", "rank").collect()
        good = dict(r for r in rows if r[0] is not None and (r[0] < 30 or 100 <= r[0] < 140))
        for query in (0, 100):
            v = {i: np.array(x, np.float32).astype(float) for i, x in good.items()}
            expected = sorted((np.sqrt(((v[i] - v[query]) ** 2).sum()), i) for i in v if i != query)[:10]
            own = [(r["score"], r["vec_id"]) for r in found if r["query_id"] == query]
            assert [i for _, i in own] == [i for _, i in expected]
        assert {r["query_id"] for r in found} == {0, 100}

    def test_few_and_no_rows(self, spark):
        df = spark.createDataFrame([(0, [1.0, 2.0], 1, "v"), (1, [2.0, 2.0], 1, "v")], self.SCHEMA)
        assert [tuple(r) for r in nn_descent.nearest_neighbours(df).collect()] == [(0, 1, 1, 1.0)]
        assert nn_descent.nearest_neighbours(df.limit(1)).collect() == []
        assert nn_descent.nearest_neighbours(df.limit(0)).collect() == []

    def test_graph_finds_neighbours(self, spark):
        rng = np.random.default_rng(6)
        points = rng.normal(size=(3000, 16))
        nodes = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "node long, vec array<double>")
        edges = nn_descent.neighbour_graph(nodes).collect()
        d = ((points[:, None] - points[None, :200]) ** 2).sum(2)
        hits = 0
        for node in range(200):
            near = set(np.argsort(d[:, node])[1:11])
            hits += len(near & {r["near"] for r in edges if r["node"] == node})
        assert hits >= 0.9 * 2000

    @pytest.mark.parametrize("case", ["outlier", "tight group"])
    def test_distances_are_those_of_the_vectors(self, spark, case):
        rng = np.random.default_rng(7)
        points = rng.normal(size=(1500, 8))
        if case == "outlier":
            points[3] = 1e9
        else:
            points[:400] = 5.0 + 1e-5 * points[:400]
        nodes = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "node long, vec array<double>")
        found = {}
        for r in nn_descent.neighbour_graph(nodes).collect():
            found.setdefault(r["node"], set()).add(r["near"])
        hits = 0
        for node in range(100, 300):
            d = ((points - points[node]) ** 2).sum(1)
            hits += len(set(np.argsort(d)[1:11].tolist()) & found[node])
        assert hits >= 0.95 * 2000

    def test_search_enters_groups_without_a_pivot(self, spark, monkeypatch):
        monkeypatch.setattr(nn_descent, "PIVOTS", 2)
        monkeypatch.setattr(nn_descent, "PIVOTS_ROOT", 0, raising=False)
        rng = np.random.default_rng(8)
        points = np.repeat(10.0 * rng.normal(size=(8, 4)), 40, axis=0) + rng.normal(size=(320, 4))
        d = ((points[:, None] - points[None, :]) ** 2).sum(2)
        own = [(i, j, float(d[i, j]), False) for i in range(320) for j in range(i - i % 40, i - i % 40 + 40) if i != j]
        graph = spark.createDataFrame(own, "node long, near long, distance double, is_new boolean")
        nodes = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "node long, vec array<double>")
        queries = nodes.filter("node % 20 = 0").withColumnRenamed("node", "query")
        found = {}
        for r in nn_descent.search(graph, nodes, queries).collect():
            found.setdefault(r["query"], {})[r["node"]] = r["distance"]
        assert len(found) == 16
        for query, near in found.items():
            expected = set(np.argsort(d[query])[:11].tolist())
            assert expected <= set(sorted(near, key=near.get)[:11])


class TestPipeline:
    def test_stages_keep_columns_and_take_effect(self, spark, make):
        good = " ".join(WORDS[:300] + ["und"] + WORDS[300:])
        texts = [good, good + " mehr", "kurz", None, "mail me at a@b.co " + " ".join(reversed(WORDS)), "spam " * 900]
        docs = make(texts, clashing=False)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, "")
            assert after.columns == docs.columns, name
            docs = spark.createDataFrame(after.collect(), after.schema)
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= {0, 4}
        assert all("a@b.co" not in r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)

    def test_empty_table(self, spark, make):
        docs = make([], clashing=False)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert docs.collect() == []

    def test_whole_run(self, spark):
        rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
        assert rows and all(len(r["ids_sha256"]) == len(hashlib.sha256().hexdigest()) for r in rows)
