"""Prefix trie, language identification and ranked search against brute force, with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termlake.llm import language_id, prefix_trie, queries, ranked_search
from termlake.llm.ordered import in_parts, neighbours, running

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_ranked_search"])
def test_sql_twins(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


# --- running sums and neighbours ----------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 7])
def test_sums_and_neighbours_over_parts(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(k), int(v), int(x)) for k, v, x in zip(np.where(rng.random(400) < 0.6, 3, rng.integers(0, 40, 400)), rng.permutation(400), rng.integers(0, 9, 400))]
    table = in_parts(spark.createDataFrame(rows, "k long, v long, x long"), parts, ["k", "v"], "test")
    want, last = {}, collections.Counter()
    for k, v, x in sorted(rows):
        last[k] += x
        want[v] = last[k]
    assert {r["v"]: r["total"] for r in running(table, "k", {"total": "x"}).collect()} == want
    by = collections.defaultdict(list)
    for k, v, _ in sorted(rows):
        by[k].append(v)
    near = {v: (a, b) for vs in by.values() for a, v, b in zip([None, *vs], vs, [*vs[1:], None])}
    assert {r["v"]: (r["before"], r["after"]) for r in neighbours(table, "k", "v").collect()} == near


# --- prefix trie --------------------------------------------------------------------------------
def trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            convs[c].append((role or "", text or ""))
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = hashlib.sha256(",".join(str(c) for c in m if made[c] == p).encode()).hexdigest()
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], sum(not kids[q] for q in below), saved, ends))
    return sorted(out)


def tables():
    rng = np.random.default_rng(5)
    say = lambda: str(rng.choice(["hi", "hello there", "", "naïve 🙂", "yes"]))
    rows = [(c, int(t), str(rng.choice(["user", "bot"])), say()) for c in [*range(0, 60), *range(100, 140), 205, 399] for t in rng.permutation(int(rng.integers(0, 9)))]
    hot = [(700, t, "user", f"turn {t % 7}") for t in range(300)]
    odd = [(None, 0, "user", "x"), (1, None, None, None), (1, None, "a", "b"), (1, 2, "user", "hi"), (1, 2, "user", "hi"), (-5, 0, "user", "hi"), (-105, 1, "user", "hi"), (2, 0, None, "t")]
    same = [(c, t, "user", "copy") for c in range(900, 960) for t in range(3)]
    return {"mixed": rows + odd, "hot": hot + rows[:40], "copies": same, "one": [(7, 0, "u", "t")], "turnless": [(c, 0, "u", "t") for c in range(1, 30)]}


@pytest.mark.parametrize("kind", ["mixed", "hot", "copies", "one", "turnless"])
@pytest.mark.parametrize("rest", [2, 20_000])
def test_prefix_trie(spark, kind, rest):
    rows = tables()[kind]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    got = prefix_trie.prefix_trie(df, rest=rest).collect()
    assert sorted((tuple(r)[:8] for r in got), key=lambda r: (r[0], r[1])) == trie(rows)
    # the tour visits every arc once
    assert sorted(x for r in got for x in (r["enter"], r["leave"])) == list(range(2 * len(got)))


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "u", "t")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df).count() == 0 and prefix_trie.prefix_trie(df.limit(0)).count() == 0


# --- language -----------------------------------------------------------------------------------
def model_of(rows, word_share, gram_share):
    """The counts and scores in plain Python."""
    words, grams, n_rows = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        n_rows[lang] += 1
        words[lang].update(w for w in re.findall(r"[^\W\d_]+", text.lower()))
    for lang, count in words.items():
        for w, c in count.items():
            for n in range(1, 5):
                p = w if n == 1 else f" {w} "
                for i in range(len(p) - n + 1):
                    grams[lang, n][p[i : i + n]] += c
    level = [{x: words[x] for x in n_rows}] + [{x: grams[x, n] for x in n_rows} for n in range(1, 5)]
    kept = []
    for n, by in enumerate(level):
        share = gram_share if n else word_share
        total = {x: sum(c.values()) for x, c in by.items()}
        have = {x: {k: v for k, v in c.items() if v >= share * total[x]} for x, c in by.items()}
        kinds = {k for c in have.values() for k in c}
        floor = {x: math.log(0.5) - math.log(total[x] + 0.5 * len(kinds) + 1) for x in by}
        kept.append((kinds, {x: {k: math.log(v + 0.5) - math.log(0.5) for k, v in c.items()} for x, c in have.items()}, floor))
    return {x: math.log(n / sum(n_rows.values())) for x, n in n_rows.items()}, kept


def predict(prior, kept, text):
    total = dict(prior)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for n in (0, 4, 3, 2, 1):
            p = w if n < 2 else f" {w} "
            units = [w] if n == 0 else [p[i : i + n] for i in range(len(p) - n + 1)]
            kinds, above, floor = kept[n]
            known = [u for u in units if u in kinds]
            if known and 2 * len(known) >= len(units):
                for x in total:
                    total[x] += sum(above[x].get(u, 0.0) + floor[x] for u in known) / len(known)
                break
    best = min(total, key=lambda x: (-total[x], x))
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


@pytest.mark.parametrize("shares", [(1 / 50_000, 1 / 20_000), (1 / 20, 1 / 60)])
def test_language_as_plain_python(spark, shares):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    train = [(t, x) for i, t, x in rows if i % 3 and t is not None and x is not None]
    prior, kept = model_of(train, *shares)
    model = language_id.learn(docs.filter("doc_id % 3 <> 0"), *shares)
    got = language_id.detect(docs.withColumn("held_out", F.lit(True)), model).collect()
    texts = {i: t for i, t, _ in rows}
    for r in got:
        want, score = predict(prior, kept, texts[r["doc_id"]])
        assert r["lang_pred"] == want and abs(r["score"] - score) < 1e-4


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 34 !?", "en"), (-4, "the the " * 20_000, None), (None, "the of and", None), (-5, "日本", None), (-6, "ÉÉ", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash"))
    rows = language_id.identify(both).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == both.count()
    for i in (-1, -2, -3):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[-4]["lang_pred"] == "en" and got[-5]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in rows)
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.98 * len(held)
    # nothing to learn from
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0


# --- ranked search ------------------------------------------------------------------------------
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranking(docs, items, k):
    cut = [(i, WORD.findall(t.translate(LOWER))) for i, t in docs if i is not None and t is not None]
    cut = [(i, w, collections.Counter(w)) for i, w in cut if w]
    n, length = len(cut), sum(len(w) for _, w, _ in cut)
    df, out = collections.Counter(t for *_, c in cut for t in c), []
    for item, text in items:
        own, scored = set(WORD.findall((text or "").translate(LOWER))), []
        for i, w, c in cut:
            m = 50 + (50 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda r: (r[0] is not None, r))


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.3, int(rng.integers(1, 60)))) for _ in range(n)]


@pytest.mark.parametrize("block,coordinates,sample", [(2, 3, 40), (8, 128, 8192)])
def test_ranked_search(spark, block, coordinates, sample):
    docs = list(enumerate(corpus(1, 300))) + [(1000, None), (1001, ""), (1002, "!!!"), (None, "w1 w2"), (5, "w1 w7 W9"), (1003, "same text w5")] + [(2000 + i, "same text w5") for i in range(70)]
    items = [(1, "w1 w5 w9 w11 w3"), (2, "W7, w250 w120"), (3, None), (4, "nothing known"), (2, "w7 w250 w120"), (None, "w12 same"), (6, " ".join(f"w{i}" for i in range(1, 200)))]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string")
    asked = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank long")
    got = ranked_search.ranked_search(df, asked, k=20, most_items=4, sample=sample, shard_docs=50, block=block, coordinates=coordinates).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r)) == ranking(docs, items, 20)


def test_ranked_search_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.ranked_search(docs, none).count() == 0
    items = spark.createDataFrame([(1, "a"), (2, "z")], "item_id long, text string")
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    assert [tuple(r)[:3] for r in ranked_search.ranked_search(docs, items).collect()] == [(1, 1, 1)]


@pytest.mark.parametrize("asked,other", [("w1 w5 w9", "nothing of it here"), ("w1 w5 w9", "w1 and x y z"), ("w5000 w5001", "nothing of it here")])
def test_shards_without_lists(spark, asked, other):
    """In a large table some shards have no asked term at all, or only such as can't lift a document over the threshold."""
    docs = [(i, f"w1 w5 w9 w{i}") for i in range(10, 110)] + [(1000 + i, other) for i in range(200)]
    items = [(1, asked), (None, "w7000"), (1, asked)]
    found = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5, shard_docs=16)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is not None, r)) == ranking(docs, items, 5)
    assert "Broadcast" not in found._jdf.queryExecution().toString()  # it might wait behind the whole search
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in found.inputFiles() if "search-index" in f]
    assert sum(g.num_rows for g in groups) >= 16 and max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= 2


def test_blocks_are_skipped_and_nothing_is_lost():
    """Documents of a few topics: blocks of other topics aren't read, and the answers are those of all documents."""
    rng, n, topics = np.random.default_rng(3), 1200, 12
    rows = [np.unique(np.concatenate([rng.choice(40, 6) + 40 * (i * topics // n), [480 + int(rng.integers(0, 8))]])) for i in range(n)]
    table = pa.table({"doc_id": np.arange(n), "n": np.full(n, 7), "terms": rows, "tfs": [np.ones(len(r), np.int64) for r in rows]})
    table = table.set_column(2, "terms", table["terms"].cast(pa.list_(pa.int32())))
    hashes = [np.array(sorted({40 * q + 3, 40 * q + 9, 40 * q + 17, 480, 484}), np.uint64) for q in range(topics)]
    batch = ranked_search.Batch(list(range(topics)), [*hashes, np.arange(488, dtype=np.uint64)])
    batch.terms.pop()  # it only made the vocabulary whole
    vectors = ranked_search.Rows(table, n, 7 * n)
    df = np.bincount(vectors.terms, minlength=488)
    batch.weigh(n, 7 * n, df, np.full(488, vectors.vals.max()))
    x = vectors.dense(488).astype(float)
    full = [x[:, t] @ batch.weight[t] for t in batch.terms]
    batch.plan(np.array([np.sort(s)[-40] for s in full]), 128)
    sketch = np.random.default_rng(1).choice([-1.0, 1.0], (488, 64)).astype(np.float32)
    searcher = ranked_search.Searcher(batch, 10)
    for a in range(0, n, 300):
        searcher(ranked_search.build_shard(ranked_search.Rows(table.slice(a, 300), n, 7 * n), batch, 8, sketch))
    for q, s in enumerate(full):
        want = sorted((-v, i) for i, v in enumerate(s.tolist()) if v > 0)[:10]
        assert [(-v, i) for i, v in zip(*(y.tolist() for y in searcher.best.kept[q]))] == want
    assert 0 < searcher.read < 0.6 * searcher.told


# --- pipeline -----------------------------------------------------------------------------------
def test_stages_take_any_column_name(spark):
    names = ["_id", "_key", "_least", "_text", "rejected_id", "REJECTED_KEY", "least_mark", "struck_text", "kept", "a.b", "component_id", "posterior"]
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(i, t, "en", "s", len(t)) for i, t in [(1, base), (2, base + " more"), (3, "short"), (4, " ".join(f"v{k}" for k in range(90)))]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        table = table.withColumn(n, F.lit(n))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        if name == "sentencepiece":
            assert out.count() == 4
            continue
        assert out.columns == table.columns, name
        assert all(r[n] == n for r in out.collect() for n in names), name
        if name != "quality_rules":  # four rows say nothing of how rules agree
            assert {r["doc_id"] for r in out.collect()} == ({1, 3, 4} if name == "near_duplicates" else {1, 2, 3, 4}), name
