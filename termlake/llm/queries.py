"""The registered queries of the corpus operators, with their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, decontam, language_id, main_text, near_dups, ngram_lm, pieces, prefix_trie, quality, ranked_search, repeats, token_counts, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of every text; each task decodes what it encoded and compares the bytes (lossless)."""
    return pieces.encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model")).drop("ids")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.struck_documents(_table(spark, sf_dir, "documents"), length=100)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("enter", "leave")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_near_duplicates, op3_main_text, op4_quality_classifier, op5_sentencepiece, op6_quality_rules, op7_language_model,
        op8_repeats, op9_decontamination, op10_token_counts, op11_prefix_trie, op12_language_id, op13_ranked_search,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM w, unnest(range(1, greatest(2, len(w) - 1))) AS t(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x
),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
""",
    "op8_repeats": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM d, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
run AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM again)
),
span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, r),
gap AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span
),
rest AS (
  SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
    string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS h
  FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN rest USING (doc_id)
""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE len(w) > 0
),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, greatest(1, len(w) - n + 2))) AS t(i)
),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
seen AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN seen USING (doc_id) LEFT JOIN item USING (doc_id)
""",
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv_id, list(x ORDER BY pos) AS turns,
    list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::BIGINT, 1))::BIGINT) AS bytes
  FROM t GROUP BY conv_id
),
cut AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b:
    list_reduce(list_concat([xor(c, b)], range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h
  FROM own
),
made AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM cut c LEFT JOIN cut b ON b.conv_id = c.conv_id - c.conv_id % 100
),
member AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS node FROM made, unnest(range(0, len(turns) + 1)) AS u(d)),
node AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(any_value(node[depth].text)), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM member GROUP BY node, depth
),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids USING (node)),
below AS (
  SELECT node[1:d] AS node, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM full_node, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM full_node n JOIN below b ON b.node = n.node LEFT JOIN node p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
),
b AS (
  SELECT item_id, row_number() OVER () AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
asked AS (SELECT DISTINCT item, item_id, unnest(w) AS t FROM b),
total AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
cell AS (
  SELECT doc_id, k, n, t, count(*) AS tf FROM (SELECT doc_id, row_number() OVER () AS k, len(w) AS n, w FROM d), unnest(w) AS u(t)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL
),
weight AS (SELECT t, floor(1000 * ln((2 * any_value(total.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM cell, total GROUP BY t),
score AS (
  SELECT item, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * cell.n * total.n) // total.l)))))::BIGINT AS score
  FROM asked JOIN cell USING (t) JOIN weight USING (t), total GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 50
""",
}
