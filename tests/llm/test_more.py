"""Scale paths, odd rows and the pipeline against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termlake.llm import cotrain, decontam, main_text, near_dups, ngram_lm, pieces, quality, repeats, token_counts, token_files

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components(texts, width, percent):
    """Smallest id reachable over links, by comparing all pairs."""
    sets, up = {i: shingles(t, width) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def words(rng, n, kinds=400):
    return [f"w{k}" for k in rng.integers(0, kinds, n)]


# --- near duplicates ----------------------------------------------------------------------------
@pytest.mark.parametrize("block", [8, 512])
def test_large_buckets_lose_no_link(spark, block):
    rng, texts = np.random.default_rng(2), {}
    base = words(rng, 120)
    for i in range(60):  # near copies: most link with the first one, some only with each other
        w = list(base)
        for k in rng.choice(len(w), int(rng.integers(0, 6)), replace=False):
            w[k] = f"x{i}-{k}"
        texts[i] = " ".join(w)
    row = words(rng, 400, 5000)
    for i in range(40):  # a chain of which only neighbours link
        texts[100 + i] = " ".join(row[6 * i : 6 * i + 140])
    for i in range(30):
        texts[200 + i] = " ".join(words(rng, 50))
    texts |= {300: None, 301: "", 302: texts[100]}
    table = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(302, texts[100]), (None, texts[0])], "doc_id long, text string")
    got = near_dups.near_duplicates(table, block=block).collect()
    want = components(texts, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert len(got) == len(texts) + 2 and all(r["kept"] == (r["doc_id"] in (None, r["component_id"])) for r in got)


def test_components_of_a_long_chain(spark):
    order = np.random.default_rng(0).permutation(5000).tolist()
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "src long, dst long")
    got = near_dups.components(edges)
    assert got.count() == 4999 and got.filter("component_id <> 0").count() == 0


# --- language model -----------------------------------------------------------------------------
def test_scores_do_not_depend_on_partitions_or_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(words(rng, int(rng.integers(0, 60)), 30))) for i in range(150)]
    rows += [(3, rows[3][1]), (200, rows[3][1]), (None, None)]
    seen = None
    for parts, block, shard in ((1, 6 << 20, 12 << 20), (4, 700, 900), (16, 300, 5000)):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 9), r["n_known"], r["train_tokens"]) for r in ngram_lm.score_texts(table, block=block, shard=shard).collect()))
        assert seen is None or got == seen
        seen = got
    of = {x[1]: x[2] for x in seen if not x[0]}
    assert of[3] == of[200]  # equal texts score alike, held out or not


def test_select_directory_and_tries(tmp_path):
    rng = np.random.default_rng(1)
    w = np.sort(rng.choice(1000, 50, replace=False))
    rank = np.sort(rng.integers(0, 50, 400))
    key = np.unique(rank * 1001 + rng.integers(0, 1000, 400))
    up = np.sort(rng.integers(0, len(key), 900))
    key3 = np.unique(up * 1001 + rng.integers(0, 1000, 900))
    uri = str(tmp_path / "trie")
    counts = rng.integers(1, 64, len(key3))
    ngram_lm.Trie.build(uri, w, (key // 1001, key % 1001, np.ones(len(key), int)), (key3 // 1001, key3 % 1001, counts), 1000)
    t = ngram_lm.Trie.open(uri)
    r = t.find_words(w)
    assert (r == np.arange(50)).all() and (t.find_words(np.setdiff1d(np.arange(1000), w)) == -1).all()
    i = t.find("pairs", key // 1001, key % 1001)
    assert (i == np.arange(len(key))).all()
    j = t.find("triples", key3 // 1001, key3 % 1001)
    assert (ngram_lm.COUNTS[t.triples_codes[j]] == counts).all()
    assert (t.kinds("pairs", np.arange(50)) == np.bincount(key // 1001, minlength=50)).all()


# --- main text ----------------------------------------------------------------------------------
def test_main_text_table(spark):
    page = "<article><h1>Title</h1><p>" + "word " * 40 + "</p></article>"
    rows = [(1, "u", page, "x"), (2, "v", None, "x"), (3, "w", "", None), (1, "u", page, "x"), (None, None, "<p>alone</p>", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in main_text.extract_main_text(table).collect())
    want = "Title\n" + ("word " * 40).strip()
    assert got == [(0, "alone"), (1, want), (1, want), (2, ""), (3, "")]
    assert main_text.extract_main_text(table.limit(0)).count() == 0


def test_embedded_elements_and_unlucky_names():
    assert main_text.main_text("<article><p>one</p><svg class='i'/><p>two</p></article>") == "one\ntwo"
    assert main_text.main_text("<article><p>one</p><iframe src=x><p>two</p></article>") == "one\ntwo"
    assert main_text.main_text("<p>one<select><option>no</select> more</p><p>two</p>") == "one more\ntwo"
    long = ("word " * 60).strip()
    assert main_text.main_text(f"<div class=related><p>{long}</p><p>{long}</p></div><div class=share>Share</div>").startswith(f"{long}\n{long}")
    assert main_text.main_text(f"<p>{long}</p><div class=comments><p>{long}</p><p>{long}</p></div>") == long


# --- classifier ---------------------------------------------------------------------------------
def test_classifier_on_rows_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = labels.filter("doc_id % 4 = 1")
    got = cotrain.quality_scores(docs, labels.filter("doc_id % 4 <> 1")).join(unseen, "doc_id").collect()
    y = np.array([r["quality"] == 1 and r["toxic"] == 0 for r in got])
    right = {v: float(np.mean((np.array([r[v] for r in got]) >= 0.5) == y)) for v in ("score", "text_score", "meta_score")}
    assert right["score"] >= max(y.mean(), 1 - y.mean()), right
    assert right["score"] >= right["text_score"] - 0.03 and right["score"] >= right["meta_score"] - 0.03, right
    assert cotrain.quality_scores(docs.limit(0), labels).count() == 0


# --- odd rows for all ---------------------------------------------------------------------------
LONG = " ".join(f"z{k * 7919 % 20011}" for k in range(20_000))
ROWS = [(1, "one two three four five six", "en", "s", 1, "x"), (1, "one two three four five six", "en", "s", 1, "x"), (2, LONG, None, None, None, None), (None, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, LONG + " end", "en", "s", 1, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, COLUMNS + ", n_tokens string")


def test_repeated_rows_and_long_texts(spark, odd):
    path, byte, piece = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    ids = sorted((i is None, i or 0) for i, *_ in ROWS)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, " ".join(LONG.split()[5000:5013])), (None, None)], "item_id long, text string")
    results = {
        1: token_files.read_token_files(token_files.write_token_files(odd, path, 2, file_bytes=4000)), 2: near_dups.near_duplicates(odd), 4: cotrain.quality_scores(odd, labels), 5: pieces.encode(odd, piece),
        6: quality.judged(odd), 7: ngram_lm.score_texts(odd), 8: repeats.struck_documents(odd), 9: decontam.contamination(odd, items), 10: token_counts.token_counts(odd, byte),
    }
    for n, df in results.items():
        rows = df.collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == ids, n
        twice = [tuple(v for k, v in r.asDict().items() if k not in ("start", "text_key")) for r in rows if r["doc_id"] == 1]
        assert repr(twice[0]) == repr(twice[1]), n
    two = {r["doc_id"]: r for r in results[2].collect()}
    assert two[4]["component_id"] == 2 and not two[4]["kept"]
    eight = {r["doc_id"]: r for r in results[8].collect()}
    assert eight[4]["n_removed"] == len(LONG) and eight[2]["n_removed"] == 0
    assert {r["doc_id"] for r in results[9].collect() if r["items"]} == {2, 4}


def test_token_files_roll_over(odd):
    manifest = token_files.write_token_files(odd, public_tokenizers.path("word_bpe_49k.json"), 2, file_bytes=8)
    assert manifest.filter("part > 0").count() > 0
    rows = sorted((tuple(r) for r in token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert [r[1] for r in rows] == np.cumsum([0] + [r[2] for r in rows[:-1]]).tolist()


def test_decoding_gives_the_texts_back(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(7, "日本語 ▁x é\x1c y  two  spaces "), (8, " lead"), (9, "don't")], "doc_id long, text string")
    for table in (odd, rows):
        want = sorted((r["doc_id"] or 0, r["text"] or "") for r in table.collect())
        got = pieces.decode_ids(pieces.encode(table, path), path)
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == want
    assert pieces.decode_ids(pieces.encode(rows.limit(0), path), path).count() == 0


# --- quality and the pipeline -------------------------------------------------------------------
def plain_quality(rows):
    """(posterior, kept) of each text by the label model, written out with plain numbers."""
    stats = []
    for t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        at, marked = {}, set()
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        for v in at.values():
            if len(v) > 1:
                marked |= {k + j for k in v for j in range(5)}
        n, chars = len(w), sum(map(len, w))
        count = lambda kind: len(re.findall(f"[{kind}]", t))  # noqa: B023, E731
        mean = chars / max(n, 1)
        stats.append((n, chars, count("#*$%&|<>"), len(lines) - len(set(lines)), len(marked), [
            -(count("#*$%&|<>") / max(n, 1) > 0.10), -(len(marked) / max(n, 1) > 0.20), -((len(lines) - len(set(lines))) / max(1, len(lines)) > 0.30), -(count("A-Z") / max(chars, 1) > 0.50), -(count("!?") / max(n, 1) > 0.25),
            -(count("0-9") / max(chars, 1) > 0.40), 1 if 3 <= mean <= 9 else -1 if not 2 <= mean <= 12 else 0, 1 if n >= 20 else -1 if n < 5 else 0,
        ]))
    votes = [s[5] for s in stats]
    start = {1: {1: 0.8, -1: 0.01}, 0: {1: 0.7, -1: 0.3}}
    rates = [{c: dict(v) for c, v in start.items()} for _ in range(8)]

    def posterior(v):
        odds = math.log(0.8 / 0.2) + sum(math.log(max(r[1][x], 1e-6) / max(r[0][x], 1e-6)) for r, x in zip(rates, v, strict=True) if x)
        return 1 / (1 + math.exp(-odds))

    for _ in range(15):
        p = [posterior(v) for v in votes]
        n, good = len(votes), sum(p)
        new = []
        for k in range(8):
            r = {1: {}, 0: {}}
            for x in (1, -1):
                g, both = sum(q for q, v in zip(p, votes, strict=True) if v[k] == x), sum(v[k] == x for v in votes)
                r[1][x] = (g + 0.02 * n * start[1][x]) / (good + 0.02 * n)
                r[0][x] = (both - g + 0.02 * n * start[0][x]) / (n - good + 0.02 * n)
            r[1][-1] = min(r[1][-1], r[0][-1] / 20)
            new.append(r)
        moved = max(abs(a[c][x] - b[c][x]) for a, b in zip(new, rates, strict=True) for c in (0, 1) for x in (1, -1))
        rates = new
        if moved < 1e-4:
            break
    out = []
    for s in stats:
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        p = posterior(s[5])
        out.append((s[:5], p, not failed and p >= 0.5))
    return out


def spell(kind, k):
    return kind + "".join(chr(97 + k // 26**j % 26) for j in range(3))


def planted():
    rng = np.random.default_rng(9)
    some = lambda kind, n: " ".join(spell(kind, int(k)) for k in rng.integers(0, 17_000, n))
    shared, bench = some("pas", 60), [some("ben", 20) for _ in range(3)]
    rows = [(i, some("wo", int(rng.integers(15, 90)))) for i in range(60)]
    rows += [(60, rows[5][1]), (61, rows[7][1] + " more"), (62, None), (63, ""), (64, "###!!! $$$ %%% &&& *** ||| <<< >>> ### $$$ !!! ??? ### $$$"), (65, "again and again and " * 30), (66, "SHOUT LOUD " * 3 + "A B C D E F G H I J")]
    rows += [(70 + k, some("own", 30) + "\n" + shared + "\n" + some("tail", 4)) for k in range(4)]
    rows += [(80 + k, bench[k] + " " + some("free", 5 + 200 * k)) for k in range(3)]
    return rows, bench


def test_quality_counts_and_verdict(spark):
    rows, _ = planted()
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    got = {r["doc_id"]: r for r in quality.judged(table).collect()}
    for (i, _), (counts, p, kept) in zip(rows, plain_quality([t for _, t in rows]), strict=True):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts, i
        assert r["posterior"] == pytest.approx(p, abs=1e-6) and r["kept"] == kept, i


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, bench = planted()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {i: t for (i, t), (_, _, ok) in zip(rows, plain_quality([t for _, t in rows]), strict=True) if ok}
    assert not {62, 63, 64, 65} & set(kept)
    comp = components(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    assert not {60, 61} & set(kept)
    seen, cut = set(), {}
    for i in sorted(kept):
        b = kept[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        cut[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    assert cut[70] == kept[70] and all(len(cut[71 + k]) < len(kept[71 + k]) for k in range(3))
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[k : k + 13]) for t in bench for w in [plain.findall(t)] for k in range(len(w) - 12)}
    final = {}
    for i, t in cut.items():
        w, hit = plain.findall(t.translate(LOWER)), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            final[i] = t
    assert 80 not in final and 82 in final
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got.keys() == final.keys()
    texts = {r["doc_id"]: r["text"] for r in pieces.decode_ids(out, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert texts == final and all(r["lossless"] for r in got.values())
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in got.values())


def test_stages_on_empty_and_odd_tables(spark, odd):
    table = odd.withColumnsRenamed({"n_tokens": "kept"})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), "/root/testdata/sf0.001").count() == 0, name
        out = stage(spark, table, "/root/testdata/sf0.001")
        assert name == "sentencepiece" or out.columns == table.columns, name
        assert out.count() >= (name != "quality_rules"), name


def test_digests_are_of_whole_texts(odd):
    rows = {r["doc_id"]: r for r in repeats.struck_documents(odd).collect()}
    assert rows[2]["kept_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert odd.filter(F.col("doc_id") == 3).count() == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from termlake.llm.common import scratch

    class Session:
        def __init__(self, **conf):
            self.conf = self
            self.values = conf

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    with pytest.raises(ValueError, match="share"):
        scratch(Session(**{"spark.master": "spark://host:7077"}), "x")
    assert scratch(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://h/c/"}), "x").startswith("hdfs://h/c/termlake-x-")
    assert "termlake-" in scratch(Session(**{"spark.master": "local[2]"}), "x")
