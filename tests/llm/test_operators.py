"""The corpus operators against brute force on small fixtures, with odd rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from termlake.llm import cotrain, decontam, main_text, near_dups, ngram_lm, pieces, quality, queries, repeats, suffix_array, token_counts, token_files

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
BASE = " ".join(f"w{k * 7919 % 1000}" for k in range(60))
ODD = [
    (1, BASE), (2, BASE + " tail"), (3, None), (4, ""), (5, "  a  b\n\n c\t"), (6, "don't <|endoftext|> x"), (7, "日本語 ▁x é\x1c y"), (8, BASE), (9, "x " * 4000),
    (10, "Short."), (None, "no id"), (12, "Other text. " * 3 + BASE.upper()),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 200):
        for k in (2, 5):
            t = np.append(rng.integers(1, k, n), 0)
            b = bytes(t.tolist())
            sa = suffix_array.suffix_array(t)
            assert sa.tolist() == sorted(range(len(t)), key=lambda i: b[i:])
            lcp = suffix_array.common_prefixes(t, sa, 12)
            for i in range(1, len(sa)):
                x, y = b[sa[i - 1] :], b[sa[i] :]
                same = next((m for m in range(min(len(x), len(y))) if x[m] != y[m]), min(len(x), len(y)))
                assert lcp[i] == min(12, same)


def test_token_files(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in token_files.read_token_files(token_files.write_token_files(docs, path, 2)).collect()}
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.write_token_files(empty, path, 2).count() == 0


def test_damaged_frame_is_noticed(docs):
    row = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2).first()
    reader = token_files.Reader(row["file"])
    assert len(reader.ids) == row["n_docs"]
    name = row["file"].removeprefix("file://")
    raw = bytearray(open(name, "rb").read())
    raw[int(reader.starts[0]) + 8] ^= 255
    open(name, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017
        token_files.Reader(row["file"]).raw(0)


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(docs).collect()}
    sets = {i: (lambda w: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))) for i, t in ODD}
    assert {i: g[0] for i, g in got.items()} == {i: len(s) for i, s in sets.items()}
    assert [got[i][1] for i in (1, 2, 8)] == [1, 1, 1] and got[12][1] == 1  # its three extra words cost 4 of 62 shingles
    assert got[3] == (0, 3, True) and got[None][2]
    assert near_dups.near_duplicates(empty).count() == 0


def test_confirmed_components_match_brute_force():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > p], rng.integers(0, 2**60, int(200 * p)).astype(np.uint64)])) for p in np.linspace(0, 0.3, 60)]
    for n in (20, 60):
        forest = near_dups.confirmed(sets[:n], 85)
        slow = near_dups._Forest(n)
        for i in range(n):
            for j in range(i):
                c = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                    slow.join(i, j)
        assert [forest.root(i) for i in range(n)] == [slow.root(i) for i in range(n)]


def test_main_text():
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use</div><article><h1>A &amp; B</h1><p>One\n two<br><p>Three</p><div class=comments><p>first!</p></div></article><aside>side</aside><footer>f</footer>"
    assert main_text.main_text(page) == "A & B\nOne two\nThree"
    assert main_text.main_text("<p>only a short page</p>") == "only a short page"
    assert main_text.main_text("") == "" and main_text.main_text("<p") == ""
    long = "word " * 60
    assert main_text.main_text(f"<ul><li><a href=x>{long}</a></li></ul><div><p>{long}</p><p>x</p></div>") == (long.strip() + "\nx")


def test_main_text_windows_decide_with_and_without_articles():
    prose = [f"Paragraph {k} " + "word " * 30 + "end." for k in range(4)]
    divs = "".join(f"<div>{p}</div>" for p in prose)
    card = "<article><h3>Next week</h3><p>A teaser card.</p></article>"
    assert main_text.main_text(f"<body><div class=promo>Buy</div>{divs}<footer>f</footer>{card}").split("\n")[:4] == prose
    assert main_text.main_text(f"<body>{divs}<ul>" + "<li><a href=x>Item</a>" * 4 + "</ul><div>Imprint</div>") == "\n".join(prose)  # dives at the links, no surge after
    article = "<article><h1>T</h1>" + "".join(f"<p>{p}</p>" for p in prose)
    assert main_text.main_text(f"<div>Log in</div>{article}<p>Last.</p></article><div>Imprint</div>") == "\n".join(["T", *prose, "Last."])
    assert main_text.main_text(f"{article}</article><div>Imprint</div><div>{prose[0]}</div>") == "\n".join(["T", *prose, "Imprint", prose[0]])  # text outside surges too
    assert main_text.main_text(article + "<div class=comments>" + "<p>first!</p>" * 3 + "</div><p>a b</p></article>") == "\n".join(["T", *prose])  # dives inside an article


def test_quality_counts(docs, empty):
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    for i, t in ODD:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at, marked = {}, set()
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        for v in at.values():
            if len(v) > 1:
                marked |= {k + j for k in v for j in range(5)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(marked))
    assert not got[9]["kept"] and got[3]["base_failed"] and not got[1]["base_failed"]
    assert quality.judged(empty).count() == 0


def test_repeats(docs, empty):
    seen, want = set(), {}
    for i, t in sorted((r for r in ODD if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    for hot in (1000, 1):
        got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, hot=hot).collect()}
        assert {i: (got[i]["n_removed"], got[i]["n_spans"]) for i in got} == {i: w[1:3] for i, w in want.items() if w[1]}
    whole = {r["doc_id"]: tuple(r)[1:] for r in repeats.struck_documents(docs).collect()}
    assert {i: whole[i] for i in want} == want
    assert repeats.struck_documents(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, BASE.upper()), (2, "short."), (3, None), (4, "w0 w919 nowhere at all")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, items).collect()}
    assert got[1]["n_hit"] == 60 and got[1]["items"] == ["1"] and got[1]["contaminated"]
    assert got[10]["items"] == ["2"] and got[3]["n_words"] == 0 and not got[7]["contaminated"]
    blocks = {r["doc_id"]: r for r in decontam.contamination(docs, items, block_windows=7).collect()}
    assert {i: (r["n_hit"], r["items"]) for i, r in blocks.items()} == {i: (r["n_hit"], r["items"]) for i, r in got.items()}
    assert not any(r["contaminated"] for r in decontam.contamination(docs, items.limit(0)).collect())
    assert decontam.contamination(empty, items).count() == 0


def test_proximity_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ["a b x b x x c", "c a", "b c", ""] + [" ".join(rng.choice(list("aabbcdx"), int(rng.integers(1, 25)))) for _ in range(60)]
    phrases = ["a b c", "a a b", "b", "d a b a", "c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string")
    for slack in (1, 2):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.contamination(docs, items, slack=slack).collect()}
        for i, t in enumerate(texts):
            w, hit, found = t.split(), set(), []
            for k, p in enumerate(phrases):
                terms = p.split()
                chains = [(x, x) for x, y in enumerate(w) if y == terms[0]]
                for term in terms[1:]:
                    chains = list({(s, x) for s, e in chains for x in range(e + 1, min(len(w), e + slack + 2)) if w[x] == term})
                found += [str(k)] if chains else []
                hit |= {x for s, e in chains for x in range(s, e + 1)}
            assert got[i] == (len(hit), found), (slack, t)


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t in ODD:
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
    assert token_counts.token_counts(empty, path).count() == 0


def test_pieces_are_lossless_and_reproducible(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    one = {r["doc_id"]: (r["lossless"], r["ids_crc32"]) for r in pieces.encode(docs, path).collect()}
    two = {r["doc_id"]: (r["lossless"], r["ids_crc32"]) for r in pieces.encode(docs.repartition(3), path, block=10).collect()}
    assert one == two and all(x[0] for x in one.values())
    assert pieces.encode(empty, path).count() == 0


def test_sampling_follows_the_lattice():
    sample = pieces.Sampler(public_tokenizers.path("piece_bpe_32k.model"), 1.0, 10.0)
    p, n = sample.pieces, 40_000
    found: dict = {}
    for x in sample(np.arange(n), ["cat"] * n):
        found[tuple(x.tolist())] = found.get(tuple(x.tolist()), 0) + 1

    def ways(t):
        if not t:
            yield (), 1.0
        for k in range(1, len(t) + 1):
            if t[:k] in p.ids:
                for rest, w in ways(t[k:]):
                    yield (p.ids[t[:k]], *rest), w * p.weight[t[:k]]

    every = dict(ways(" cat"))
    total = sum(every.values())
    assert set(found) <= set(every) and all(abs(found.get(k, 0) / n - w / total) < 0.01 for k, w in every.items())


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((1, 5), (300, 10**6), (500, 300)):
        v = np.sort(rng.integers(0, u, n))
        e = ngram_lm.EliasFano(**ngram_lm.EliasFano.encode(v, u))
        assert (e.get(np.arange(n)) == v).all()
        q = rng.integers(0, u + 5, 500)
        assert (e.successor(q)[0] == np.searchsorted(v, q)).all()


def test_language_model_beats_single_words_on_held_out(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = ngram_lm.score_texts(docs).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    assert ngram_lm.score_texts(empty).count() == 0


def test_language_model_matches_brute_force(spark, docs):
    rows = [(i, t) for i, t in ODD] + [(20 + k, f"a b c{k % 3} a b d{k} once{k}") for k in range(40)]
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"] for i, t in rows}
    train = [i for i, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c: dict = {}
    for i in train:
        t = ["<s>", *tokens[i]]
        for k in range(1, len(t)):
            for size in (1, 2, 3):
                if k - size >= -1:
                    g = tuple(t[k - size + 1 : k + 1])
                    c[g] = c.get(g, 0) + 1
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    follow: dict = {}
    for g, x in c.items():
        if len(g) > 1:
            a = follow.setdefault(g[:-1], [0, 0])
            a[0], a[1] = a[0] + x, a[1] + 1

    def prob(g):
        if len(g) == 1:
            return (c.get(g, 0) + 1) / (n + v + 1)
        total, kinds = follow.get(g[:-1], (0, 0))
        low = prob(g[1:])
        return (max(c.get(g, 0) - 0.75, 0) + 0.75 * kinds * low) / total if total else low

    want = {i: {o: sum(np.log10(prob(tuple(["<s>", *t][max(0, k - o + 1) : k + 1]))) for k in range(1, len(t) + 1)) for o in (2, 3)} for i, t in tokens.items()}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (2, 3):
        got = {r["doc_id"]: r["score"] for r in ngram_lm.score_texts(table, order=order, block=300).collect()}
        assert got.keys() == want.keys()
        for i in got:
            assert got[i] == pytest.approx(want[i][order], rel=0.01, abs=0.05 + 0.002 * len(tokens[i])), (order, i)
    assert abs(want[21][3] - want[21][2]) > 0.1


def test_classifier_accuracy(spark, docs):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = cotrain.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    good = sum(r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in got) / len(got)
    assert good > 0.8
    assert cotrain.quality_scores(docs, labels.limit(0)).filter("score <> 0.5").count() == 0


def test_pseudo_labels_come_from_the_whole_corpus(spark, monkeypatch):
    rows = [(i, ("good words here " if i % 2 else "bad spam there ") * (1 + i % 3), "en", f"s{i % 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    seen, real = [], cotrain.exchange
    monkeypatch.setattr(cotrain, "exchange", lambda *a: seen.append(real(*a)) or seen[-1])
    got = cotrain.quality_scores(docs, labels, take=0.1, max_labelled=40).collect()
    assert all(r["kept"] == (r["doc_id"] % 2 == 1) for r in got) and len(got) == 600
    for k, (chosen, n) in enumerate(seen):
        assert all(abs(x - 50 * (k + 1)) < 40 for x in n.values())  # a tenth of 500 more in each round, not of 40
        assert all(r["doc_id"] >= 100 and {r["for_text"], r["for_meta"]} & {r["doc_id"] % 2} for r in chosen.collect())
    assert len(seen) == 3


def test_pipeline_stages_keep_the_columns(spark, docs):
    table = docs.drop("n_words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns, name
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, SF).collect()} >= {1, 3, 4, None}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
