"""The written index against plain Python: statistics of pools, exact answers, what is read, what a guard finds."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlake.operators import retrieval, search_index


def texts(seed, n, kinds=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{min(int(x), kinds)}" for x in rng.zipf(1.4, int(rng.integers(0, 50)))) for _ in range(n)]


def ranking(chunks, text, codes, k, digits=6):
    """BM25 over the pool as a corpus of its own."""
    have = {c.lower() for _, _, c in chunks if c}
    wanted = {c.lower() for c in codes or []} & have
    pool = [(i, re.findall(r"\w+", (t or "").lower())) for i, t, c in chunks if not wanted or (c or "").lower() in wanted]
    n, mean = len(pool), sum(len(w) for _, w in pool) / max(1, len(pool)) or 1.0
    df = collections.Counter(t for _, w in pool for t in set(w))
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    asked, out = collections.Counter(re.findall(r"\w+", (text or "").lower())), []
    for i, w in pool:
        tf = collections.Counter(w)
        s = sum(c * idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t, c in asked.items() if tf[t])
        if any(tf[t] for t in asked):
            out.append((-round(s, digits), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, t, ["GDPR", "US-CA", "gdpr", None][i % 4]) for i, t in enumerate(texts(1, 500))]
    return rows + [(900, None, "GDPR"), (901, "", None), (902, "!!", "US-CA"), *[(1000 + i, "same text w3 w5", "GDPR") for i in range(80)]]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    df = spark.createDataFrame([(*r, None) for r in corpus], "chunk_id long, text string, jurisdiction string, vector array<double>")
    return search_index.write_index(df, str(tmp_path_factory.mktemp("index") / "one"), batch=64)


QUERIES = [
    (1, "w3 w40 w200 w7", []), (2, "W9 w9 w120 w33", ["gdpr"]), (3, "w2 w1", ["US-CA", "nowhere"]), (4, "", []), (5, None, None), (6, "unknown", ["GDPR"]),
    (7, " ".join(f"w{i}" for i in range(1, 90)), ["nowhere"]), (8, "same w1", ["GDPR", "us-ca"]),
]


@pytest.mark.parametrize("k", [1, 7])
def test_answers_are_exact(spark, index, corpus, k):
    q = spark.createDataFrame(QUERIES, "query_id long, text string, codes array<string>")
    got = collections.defaultdict(list)
    for r in index.bm25_top(q, k).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk_id"], r["score"]))
    for i, text, codes in QUERIES:
        want = ranking(corpus, text, codes, k)
        assert [x for x, _ in got[i]] == [x for x, _ in want], i
        assert np.allclose([s for _, s in got[i]], [s for _, s in want], atol=1e-5)
    with pytest.raises(ValueError, match="at most"):
        search_index.Block(index, q, most_queries=2)


def test_words_that_count_against_a_chunk(spark, tmp_path):
    """The mean over the vocabulary is negative, so frequent words have negative weights."""
    rows = [(i, " ".join(["a", "b", "c"][: 1 + i % 3] + (["d"] if i in (4, 7) else [])), None) for i in range(30)]
    df = spark.createDataFrame([(*r, None) for r in rows], "chunk_id long, text string, jurisdiction string, vector array<double>")
    index = search_index.write_index(df, str(tmp_path / "index"), batch=8)
    for text in ("a b d", "a c", "d"):
        got = index.bm25_top(spark.createDataFrame([(1, text, None)], "query_id long, text string, codes array<string>"), 4).orderBy("rank").collect()
        assert [(r["chunk_id"], r["score"]) for r in got] == ranking(rows, text, [], 4)


def test_little_is_read(spark, tmp_path):
    """Rare words decide: the long lists of words that all chunks have are not read, and a hot word is spread over blocks."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([*["the", "of"] * int(rng.integers(1, 4)), *(f"r{x}" for x in rng.integers(0, 300, 12))]), None) for i in range(1500)]
    df = spark.createDataFrame([(*r, None) for r in rows], "chunk_id long, text string, jurisdiction string, vector array<double>")
    index = search_index.write_index(df.coalesce(1), str(tmp_path / "index"), batch=500)
    search = search_index.Searcher(search_index.Block(index, spark.createDataFrame([(1, "the r5 of r9 r77", None)], "query_id long, text string, codes array<string>")), 3)
    for part in index.batches.toArrow().to_batches():
        for row in search_index.rows_of(part):
            search(row)
    want = ranking(rows, "the r5 of r9 r77", [], 3)
    assert search.kept[0][0].tolist() == [i for i, _ in want]
    assert search.read < 0.25 * search.told
    # a batch has no more entries of a word than chunks
    assert index.batches.count() == 3


def test_opened_index_and_guard(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "sell data", "gdpr"), (2, "keep data", "GDPR"), (3, "sell sell", "US-CA"), (4, None, None)], "chunk_id long, text string, jurisdiction string")
    vectors = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "chunk_id long, vector array<double>")
    path = str(tmp_path / "index")
    retrieval.build_corpus_index(chunks, vectors, path)
    q = spark.createDataFrame([(1, "sell", ["gdpr"], [2.0, 0.0]), (2, "sell", [], [1.0, 0.0])], "query_id long, text string, codes array<string>, vector array<double>")
    got = {}
    for r in retrieval.retrieve(q, search_index.open_index(spark, path), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {1: [1, 2], 2: [1, 2, 3]}  # sell is so frequent here that it counts against a chunk
    assert search_index.check_index(spark, path) is None
    spark.read.parquet(f"{path}/words").limit(1).write.mode("append").parquet(f"{path}/words")
    assert search_index.check_index(spark, path) == "postings differ"
    spark.read.parquet(f"{path}/batches").limit(1).write.mode("append").parquet(f"{path}/batches")
    assert search_index.check_index(spark, path) == "counts differ"
    with pytest.raises(ValueError, match="manifest"):
        search_index.open_index(spark, path)


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "chunk_id long, text string, jurisdiction string, vector array<double>")
    index = search_index.write_index(df, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "a", [])], "query_id long, text string, codes array<string>")
    assert index.bm25_top(q, 3).count() == 0 and search_index.check_index(spark, index.path) is None


def test_files_and_slices_are_bounded(spark, corpus, index, tmp_path, monkeypatch):
    """A file has few batches, and scoring takes fewer chunks at once where they have many words; the scores are the same."""
    df = spark.createDataFrame([(*r, None) for r in corpus], "chunk_id long, text string, jurisdiction string, vector array<double>")
    many = search_index.write_index(df.coalesce(1), str(tmp_path / "index"), batch=8)
    per_file = [r["count"] for r in many.batches.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) > 1 and max(per_file) <= search_index.PER_FILE
    q = spark.createDataFrame(QUERIES, "query_id long, text string, codes array<string>")
    block, taken = search_index.Block(index, q), []
    scorer = retrieval.Scorer(block, np.zeros((len(block.ids), 0)), 6)
    parts = index.batches.toArrow().to_batches()
    plain = retrieval.impact
    monkeypatch.setattr(retrieval, "impact", lambda tf, *rest: (taken.append(len(tf)), plain(tf, *rest))[1])
    wide, most_wide = list(scorer(parts)), max(taken)
    taken.clear()
    narrow = list(scorer(parts, cells=60 * len(block.ids)))
    assert max(taken) <= 60 < most_wide
    for one, other in zip(wide, narrow, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(one, other, strict=True))
