"""The registered queries: against SQL where there is some, and against brute force on the whole small tables."""

import hashlib
import re
from collections import Counter

import compare
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard

from cardmill.llm import bpe, licenses, pii, quality
from cardmill.llm.oracle import ORACLE
from cardmill.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: {row["doc_id"]: row for row in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_agrees(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, expected = compare.duck_rows(con, ORACLE[name])
    assert sorted(df.columns) == sorted(columns)
    assert compare.spark_rows(df) == expected


def test_bpe_is_what_the_library_gives(result, texts):
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = result("op1_byte_bpe")
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text)
        row = found[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def license_row(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    found, best = set(), 0.0
    for label, template in licenses.TEMPLATES:
        own = set(template.split())
        if 100 * len(own & set(words)) < licenses.CONTAINED_PERCENT * len(own):
            continue
        for start in range(len(words)):
            both = len(own & set(words[start : start + licenses.BLOCK_WORDS]))
            if 100 * both >= licenses.CONTAINED_PERCENT * len(own):
                found.add(label)
                best = max(best, both / len(own))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | found)), 1.0 if places else best,
    )


def test_licenses_as_by_comparing_every_block(result, texts):
    found = result("op3_license_scan")
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        assert tuple(found[doc_id])[1:] == license_row(text), doc_id
    labels = Counter(label for row in found.values() for label in row["labels"].split(",") if label)
    assert {"mit", "apache-2.0", "gpl", "cc-by-nc", "reserved"} <= labels.keys()


def test_nearest_neighbours_recall(spark, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = QUERIES["op8_nearest_neighbours"](spark, SF).orderBy("query_id", "rank").collect()
    hits = 0
    for query in ids[ids % 100 == 0]:
        distance = np.sqrt(((vectors - vectors[ids == query]) ** 2).sum(1))
        distance[ids == query] = np.inf
        own = [r for r in found if r["query_id"] == query]
        assert [r["rank"] for r in own] == list(range(1, 11))
        for r in own:
            assert r["score"] == pytest.approx(distance[ids == r["vec_id"]][0], abs=1e-12)
            hits += r["score"] <= np.sort(distance)[9] + 1e-12
    assert hits >= 0.9 * len(found)


def quality_row(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def kept_by_bands(text):
    """The verdict of the compression bands, each chunk by its own length."""
    data, compress = text.encode(), zstandard.ZstdCompressor(level=quality.ZSTD_LEVEL).compress

    def inside(part, limits):
        return limits[0] <= (len(part) / len(compress(part)) if part else 0.0) <= limits[1]

    def limits(n):
        return [b[1:] for b in quality.DOCUMENT_BANDS if n >= b[0]][-1]

    bad = 0
    for start in range(0, len(data), 4096):
        part = data[start : start + 4096]
        bad += 0 if inside(part, (1.3, 5.0) if len(part) == 4096 else limits(len(part))) else len(part)
    return inside(data, limits(len(data))) and 2 * bad <= len(data)


def test_quality_counts_as_by_brute_force(result, texts):
    found = result("op9_quality_rules")
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        row = found[doc_id]
        own = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert own == quality_row(text), doc_id
        assert row["kept"] == (not row["base_failed"] and kept_by_bands(text)), doc_id
    assert 0.5 * len(texts) < sum(row["kept"] for row in found.values()) < len(texts)


PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def pii_spans(text):
    spans = []
    for order, (kind, pattern) in enumerate(PII_PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(part) <= 255 for part in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), order, m.end(), kind))
    return sorted(spans)


def test_personal_data_as_by_brute_force(result, texts):
    found = result("op10_pii")
    assert found.keys() == texts.keys()
    n = Counter()
    for doc_id, text in texts.items():
        spans = pii_spans(text)
        row = found[doc_id]
        base = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), doc_id
        own = Counter(kind for *_, kind in spans)
        assert all(row[f"n_{kind}"] == own[kind] for kind in PII_PATTERNS)
        assert row["spans"].count("iban:") == row["n_iban"]
        n += own
    assert all(n[kind] for kind in PII_PATTERNS)


def test_mix_meets_targets(spark, texts, con):
    rows = QUERIES["op7_mix_sources"](spark, SF).collect()
    sources = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    order = sorted(set(sources.values()))
    whole = {s: sum(sizes[i] for i in sizes if sources[i] == s) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(whole.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * whole[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * whole[s]
            left -= target[s]
        open_ -= above
    for s in order:
        own = [r for r in rows if sources[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {whole[s]}
        assert own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    again = QUERIES["op7_mix_sources"](spark, SF).repartition(5).collect()
    assert sorted(again) == sorted(rows)
