"""Token counts: pieces are counted once per distinct pre-token and summed per document.

A BPE tokenizer never merges across pre-tokens, so a text's token count is the sum of its
pre-tokens' counts. Three steps, none of which makes a token id:

1. Each Arrow task splits its texts into pre-tokens. Those that repeat within a block of
   texts (`block_bytes`) are counted there, once per block; they are the map-side half of the join.
2. The others go, with their document's row key and frequency, to a table; its distinct
   pre-tokens are counted once each.
3. Counts are joined to the frequencies and summed per document.

The table of step 2 holds what stands less than `repeats` times in a block. A pre-token that stands twice in every block
still is one key with two rows a block; the counted side has one row for it, so the join can be split.
Defined cases: null text counts as empty (0 bytes, 0 tokens); a repeated row gives a repeated
result; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize

#: The library's pre-tokens of a plain word: an optional space with letters, then other signs.
#: The apostrophe is left out, as 's and the like are pre-tokens of their own.
_PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
#: A pre-token always ends between a character that is no white space and white space.
_EDGE = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_UNEVEN = re.compile(r"\s |\x00")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def units(text: str, special: tuple[str, ...]) -> list[str]:
    """Parts whose token counts add up to the text's.

    A part that starts with NUL stands for itself; any other has a space before it.
    """
    if not text:
        return []
    if _UNEVEN.search(text) or any(s in text and any(c.isspace() for c in s) for s in special):
        return ["\0" + u for u in _EDGE.split(text)]
    words = text.split(" ")
    words[0] = "\0" + words[0]
    return words


def pretokens(unit: str, special: tuple[str, ...]) -> list[str]:
    whole = unit[1:] if unit[:1] == "\0" else " " + unit
    m = _PLAIN.fullmatch(whole)
    if m and not any(s in whole for s in special):
        return [m[1], m[2]] if m[2] else [m[1]]
    return [whole] if whole else []


def n_pieces(path: str, texts: list[str]) -> list[int]:
    t = tokenizer(path)
    out: list[int] = []
    for i in range(0, len(texts), 4096):
        out += map(len, t.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False))
    return out


def _block(path: str, ids, texts: list[str], special, repeats: int):
    seen: Counter = Counter()
    for t in texts:
        seen.update(units(t, special))
    parts = {u: pretokens(u, special) for u in seen}
    freq: Counter = Counter()
    for u, n in seen.items():
        for p in parts[u]:
            freq[p] += n
    local = [p for p, n in freq.items() if n >= repeats]
    pieces = dict(zip(local, n_pieces(path, local), strict=True))
    value = {u: sum(pieces.get(p, 0) for p in ps) for u, ps in parts.items()}
    rare = {u: r for u, ps in parts.items() if (r := [p for p in ps if p not in pieces])}
    n_local, words, freqs = [], [], []
    for t in texts:
        us = units(t, special)
        n_local.append(sum(map(value.__getitem__, us)))
        mine = Counter(p for u in us if u in rare for p in rare[u])
        words.append(list(mine))
        freqs.append(list(mine.values()))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n_local, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int32()))],
        ["doc_id", "n_bytes", "n_local", "words", "freqs"],
    )


def token_counts(docs: DataFrame, path: str, limit: int = 1024, block_bytes: int = 24 << 20, repeats: int = 3) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text)."""
    spark = docs.sparkSession

    def split(batches):
        special = tuple(a.content for a in tokenizer(path).get_added_tokens_decoder().values())
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            return _block(path, table["doc_id"].combine_chunks(), table["text"].fill_null("").to_pylist(), special, repeats)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= block_bytes:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(batches):
        for batch in batches:
            (words,) = columns(batch, "word")
            yield pa.RecordBatch.from_arrays([words, pa.array(n_pieces(path, words.to_pylist()), pa.int64())], ["word", "pieces"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split_docs = slim.mapInArrow(split, "doc_id long, n_bytes long, n_local long, words array<string>, freqs array<int>")
    frequencies = materialize(split_docs.withColumn("row_key", F.monotonically_increasing_id()), "token-counts")
    rare = frequencies.select("row_key", F.explode(F.arrays_zip("words", "freqs")).alias("p")).select("row_key", F.col("p.words").alias("word"), F.col("p.freqs").alias("freq"))
    counted = rare.select("word").distinct().mapInArrow(count, "word string, pieces long")
    sums = rare.join(counted, "word").groupBy("row_key").agg(F.sum(F.col("freq") * F.col("pieces")).alias("n_rare"))
    total = (F.col("n_local") + F.coalesce("n_rare", F.lit(0))).cast("long")
    return (
        frequencies.select("row_key", "doc_id", "n_bytes", "n_local")
        .join(sums, "row_key", "left")
        .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
    )
