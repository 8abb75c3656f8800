"""Language of every text: words that are known first, ever shorter character n-grams for the others.

Learning counts lower-cased words (runs of letters and marks) per language over all given rows, and the n-grams of
`LONGEST` characters and fewer of these words, each with a mark of the word's bounds. An entry is kept if it has at
least a share of its language's counts: `word_share` of its words, `gram_share` of its n-grams of that length. So a
language has at most 1 / word_share + LONGEST / gram_share entries, however large the corpus is; that is what is
broadcast. No row, word or text is left out of the counts.

Scoring is one pass without a shuffle. A word that any language knows scores the logarithm of its frequency in each
language. Any other word takes the longest n for which at least half of its n-grams are known, and scores their mean
logarithm; a word without one known letter says nothing. Sums of words and the logarithm of a language's share of the
learned rows give the posterior; the score is that of the predicted language.

Defined cases: null text and text without a letter give `und` with score 0, and so does every text if nothing could be
learned; equal posteriors go to the language that comes first by code point; rows without a language teach nothing;
a repeated row counts again and is told again; other columns are ignored. Languages are few by nature; over
`most_languages` of them is an error, as the lang column then holds something else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, WordHasher, chunks, discard, held, materialize, mix64, small_batches, utf8

LONGEST = 4
_HASHED = U64(0x9E3779B97F4A7C15)
_COUNTS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("count", pa.int64())])


def letters_only(texts: pa.Array) -> pa.Array:
    """Lower-cased, with one space for every run of anything but letters and marks."""
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    return pc.replace_substring_regex(low, r"[^\pL\pM]+", " ")


def gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, one after the other, lengths)."""
    size = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    return raw[at], size


class Grams:
    """The n-grams of a list of words."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        stop = np.cumsum(size + 2)
        padded = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
        inner = np.repeat(stop - size - 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(data))
        padded[inner.astype(np.int64)] = data
        self.codes = np.frombuffer(padded.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U64)
        edge = np.cumsum(self.codes == 0x20)
        self.word = (edge - 1) // 2
        self.letter = self.codes != 0x20

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, word of each)."""
        m = len(self.codes) - n + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        h = self.codes[:m].copy()
        for j in range(1, n):
            h = h * _HASHED + self.codes[j : m + j]
        ok = self.letter if n == 1 else self.word[:m] == self.word[n - 1 :]
        return mix64(h[ok] * U64(0xD1342543DE82EF95) + U64(n)), self.word[:m][ok]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, counts, len(kinds)).astype(np.int64)


class Counter:
    """Words of a language seen by a task, flushed after `most` distinct ones of a chunk each."""

    def __init__(self, most: int = 1 << 21):
        self.parts: dict = {}
        self.n, self.most = 0, most

    def add(self, lang: str, keys, counts, data, size) -> bool:
        self.parts.setdefault(lang, []).append((keys, counts, data, size))
        self.n += len(keys)
        return self.n >= self.most

    def flush(self):
        for lang, parts in self.parts.items():
            keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            data, size = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            kinds, first = np.unique(keys, return_index=True)
            kinds, counts = summed(keys, counts)
            end = np.cumsum(size)
            grams = Grams(*gathered(data, (end - size)[first], end[first]))
            for n in range(LONGEST + 1):
                k, c = (kinds, counts) if n == 0 else summed(*(lambda h, w: (h, counts[w]))(*grams.of(n)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(np.full(len(k), n), pa.int32()), pa.array(k.view(np.int64)), pa.array(c)], schema=_COUNTS)
        self.parts, self.n = {}, 0


def count_entries(docs: DataFrame) -> DataFrame:
    """lang, n (0: words), key, count over docs(text, lang); partial sums, a key may come several times."""

    def count(batches):
        hasher, counter = WordHasher(SPACE_WORDS), Counter()
        for table in held(batches, 8 << 20):
            langs = np.array(table["lang"].to_pylist(), object)
            raw, off = utf8(letters_only(table["text"].combine_chunks()))
            for a, b in chunks(off):
                hashes, starts, ends, first = hasher(raw, off[a : b + 1])
                base = off[a]
                of = np.repeat(np.arange(a, b), np.diff(first))
                for lang in sorted(set(langs[a:b])):
                    mine = np.flatnonzero(langs[of] == lang)
                    keys, at, counts = np.unique(hashes[mine], return_index=True, return_counts=True)
                    data, size = gathered(raw, base + starts[mine[at]], base + ends[mine[at]])
                    if counter.add(lang, keys, counts, data, size):
                        yield from counter.flush()
        yield from counter.flush()

    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, n int, key long, count long")


class Model:
    """Known words and n-grams: sorted keys, for each its languages and how far their logarithm is above the floor."""

    def __init__(self, langs: list[str], rows: np.ndarray, totals: dict, entries: dict):
        # entries: n -> (keys, language numbers, counts), in any order
        self.langs, self.prior, self.levels = langs, np.log(rows / max(1, rows.sum())) if len(rows) else np.zeros(0), []
        for n in range(LONGEST + 1):
            keys, lang, count = entries.get(n, (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
            order = np.lexsort((lang, keys))
            keys, lang, count = keys[order], lang[order], count[order]
            kinds, first = np.unique(keys, return_index=True)
            total = np.array([totals.get((n, k), 0) for k in range(len(langs))], float)
            base = np.log(0.5) - np.log(total + 0.5 * len(kinds) + 1)
            above = (np.log(count + 0.5) - np.log(0.5)).astype(np.float32)
            self.levels.append((kinds, np.append(first, len(keys)), lang.astype(np.int32), above, base.astype(np.float32)))

    def find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds = self.levels[n][0]
        at = np.searchsorted(kinds, keys)
        at[at == len(kinds)] = 0
        return at, (kinds[at] == keys) if len(kinds) else np.zeros(len(keys), bool)

    def add(self, out: np.ndarray, to: np.ndarray, n: int, entry: np.ndarray, weight: np.ndarray) -> None:
        """Adds the scores of entries of level n to rows `to` of out(row, language)."""
        _, first, lang, above, base = self.levels[n]
        size = first[entry + 1] - first[entry]
        at = np.repeat(first[entry] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        cell = np.repeat(to, size) * out.shape[1] + lang[at]
        out += np.bincount(cell, above[at] * np.repeat(weight, size), out.size).reshape(out.shape)
        out += np.bincount(to, weight, len(out))[:, None] * base

    def words(self, keys: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores (word, language)."""
        out = np.zeros((len(keys), len(self.langs)))
        at, known = self.find(0, keys)
        have = np.flatnonzero(known)
        if len(have):
            self.add(out, have, 0, at[have], np.ones(len(have)))
        left, end = np.flatnonzero(~known), np.cumsum(size)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            h, word = Grams(*gathered(data, (end - size)[left], end[left])).of(n)
            at, known = self.find(n, h)
            total, hit = np.bincount(word, minlength=len(left)), np.bincount(word[known], minlength=len(left))
            done = (hit > 0) & (2 * hit >= total)
            use = known & done[word] if len(word) else known
            if use.any():
                self.add(out, left[word[use]], n, at[use], 1.0 / hit[word[use]])
            left = left[~done]
        return out


def learn(docs: DataFrame, word_share: float = 1 / 50_000, gram_share: float = 1 / 20_000, most_languages: int = 500) -> Model:
    """The model of docs(text, lang); rows without either are left out."""
    known = docs.filter("lang is not null and text is not null")
    small_batches(docs.sparkSession)
    counts = materialize(count_entries(known).groupBy("lang", "n", "key").agg(F.sum("count").alias("count")), "languages")
    rows = {r["lang"]: r["n"] for r in known.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(rows) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    langs = sorted(rows)
    place = {x: k for k, x in enumerate(langs)}
    sums = counts.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    totals = {(r["n"], place[r["lang"]]): r["total"] for r in sums.collect()}  # LONGEST + 1 rows a language
    share = F.when(F.col("n") == 0, word_share).otherwise(gram_share)
    # at most 1 / share entries of each language and length
    kept = counts.join(F.broadcast(sums), ["lang", "n"]).filter(F.col("count") >= share * F.col("total")).select("lang", "n", "key", "count").toArrow()
    discard(counts)
    lang = pc.index_in(kept["lang"], value_set=pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    n, key, count = kept["n"].to_numpy(), kept["key"].to_numpy().view(U64), kept["count"].to_numpy()
    return Model(langs, np.array([rows[x] for x in langs], float), totals, {k: (key[n == k], lang[n == k], count[n == k]) for k in range(LONGEST + 1)})


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs that are asked for (doc_id, held_out) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def predict(batches):
        model, hasher = shared.value, WordHasher(SPACE_WORDS)
        for table in held(batches, 4 << 20):
            raw, off = utf8(letters_only(table["text"].combine_chunks()))
            total = np.zeros((table.num_rows, len(model.langs)))
            for a, b in chunks(off):
                hashes, starts, ends, first = hasher(raw, off[a : b + 1])
                if not len(hashes):
                    continue
                keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                data, size = gathered(raw, off[a] + starts[at], off[a] + ends[at])
                scores, of = model.words(keys, data, size), np.repeat(np.arange(b - a), np.diff(first))
                for k in range(len(model.langs)):
                    total[a:b, k] = np.bincount(of, scores[inverse, k], b - a)
            any_letter = np.asarray(pc.match_substring_regex(table["text"].combine_chunks().cast(pa.large_string()).fill_null(""), r"\pL"))
            if model.langs:
                total += model.prior
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                pred = np.where(any_letter, np.array(model.langs, object)[best], "und")
                score = np.where(any_letter, score, 0.0)
            else:
                pred, score = np.full(table.num_rows, "und", object), np.zeros(table.num_rows)
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks().cast(pa.int64()), table["held_out"].combine_chunks(), pa.array(list(pred), pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, parts: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; a row with crc32(doc_id as text) mod parts = remainder teaches nothing (no doc_id: as text '')."""
    marked = docs.select("doc_id", "text", "lang", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == remainder).alias("held_out"))
    return detect(marked, learn(marked.filter("not held_out")))
