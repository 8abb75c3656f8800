"""A written index of chunks, and exact BM25 that reads the part of it that can matter.

write_index() tokenises every chunk once, in tasks that turn some thousand chunks each into one row of an inverted index
(`batches`): for each word its chunks in blocks of one level of impact, the best first, with the most occurrences and the
least length per occurrence of a block. These two bound a block's scores for any mean length, that is, for any pool of
chunks. Nothing is shuffled, and a word that all chunks have is in every batch with as many entries as the batch has
chunks. `words` tells how many chunks of a code hold a word, for the statistics of pools; a manifest tells format, counts,
codes and vector size, and open_index() holds the tables against it.

A search takes one batch after the other. For each query it reads its words' blocks by falling bound until what is unread
adds up to less than the query's k-th best score so far; chunks that were met and may still reach it are looked up for all words. Scores are exact and don't depend on what was read. Equal scores are never cut.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.store import small_batches

FORMAT = "1"
LEVELS = 24
#: Batches a file: a writer holds the rows of a file and a reader those of a file at once, however large they are, as both count rows.
PER_FILE = 4
#: Columns of a batch, each an array: of its chunks, its words (word i has blocks first[i] to first[i + 1]), its blocks, their entries.
_BATCH = {
    "chunk_id": pa.int64(), "code": pa.string(), "len": pa.int32(), "size": pa.int32(), "vectors": pa.float32(),
    "words": pa.string(), "first": pa.int32(), "most": pa.int32(), "least": pa.float64(), "entry": pa.int32(), "docs": pa.int32(), "tfs": pa.int32(),
}
_DDL = ", ".join(f"{c} array<{ {pa.int64(): 'long', pa.string(): 'string', pa.int32(): 'int', pa.float32(): 'float', pa.float64(): 'double'}[t]}>" for c, t in _BATCH.items())
_HITS = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
#: Bounds are compared with this much room, as scores are rounded and sums of doubles differ in their last digits.
ROOM = 1e-3


def okapi_idf(df, n):
    """Raw inverse frequency; what is negative becomes a quarter of the mean over the vocabulary."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def impact(tf, length, mean: float, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def invert(table: pa.Table, k1: float, b: float) -> pa.RecordBatch:
    """One batch of chunks as a row of the index."""
    lists = table["w"].combine_chunks()
    n, lengths = len(lists), np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
    flat = lists.flatten().dictionary_encode()
    kinds = flat.dictionary
    order = np.asarray(pc.array_sort_indices(kinds))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cell, tf = np.unique(rank[np.asarray(flat.indices, np.int64)] * max(1, n) + np.repeat(np.arange(n), lengths), return_counts=True)
    word, doc = np.divmod(cell, max(1, n))
    score = impact(tf, lengths[doc], max(1.0, lengths.mean() if n else 1.0), k1, b)
    level = np.clip((LEVELS * (1 - score / (k1 + 1))).astype(np.int64), 0, LEVELS - 1)
    by = np.lexsort((doc, level, word))
    word, doc, tf, level = word[by], doc[by], tf[by], level[by]
    start = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (level[1:] != level[:-1])])) if len(word) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(tf, start) if len(start) else start
    least = np.minimum.reduceat(lengths[doc] / tf, start) if len(start) else np.zeros(0)
    vectors = table["vector"].combine_chunks()
    parts = [
        table["chunk_id"].combine_chunks(), table["code"].combine_chunks(), lengths, pc.list_value_length(vectors).fill_null(0), vectors.flatten(),
        kinds.take(pa.array(order)), np.searchsorted(word[start], np.arange(len(order) + 1)), most, least, np.append(start, len(word)), doc, tf,
    ]
    cols = [pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p.cast(t) if isinstance(p, pa.Array) else pa.array(p).cast(t)) for p, t in zip(parts, _BATCH.values(), strict=True)]
    return pa.RecordBatch.from_arrays(cols, list(_BATCH))


def write_index(chunks: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, batch: int = 1024, tokens: int = 500_000) -> SearchIndex:
    """Writes the index of chunks(chunk_id, text, jurisdiction, vector) below path; a batch has at most so many chunks, and is closed at so many tokens."""
    spark = chunks.sparkSession
    small_batches(spark)

    def build(parts):
        held, n, size = [], 0, 0
        for part in parts:
            lengths = np.asarray(pc.list_value_length(part.column("w")).fill_null(0), np.int64)
            at = 0
            while at < part.num_rows:
                # rows that fit: the batch's rest, up to the one that fills it with tokens
                full = int(np.searchsorted(np.cumsum(lengths[at:]) + size, tokens)) + 1
                to = min(part.num_rows, at + min(batch - n, full))
                held.append(part.slice(at, to - at))
                n, size, at = n + to - at, size + int(lengths[at:to].sum()), to
                if n >= batch or size >= tokens:
                    yield invert(pa.Table.from_batches(held), k1, b)
                    held, n, size = [], 0, 0
        if n:
            yield invert(pa.Table.from_batches(held), k1, b)

    def frequencies(parts):
        for part in parts:
            for row in rows_of(part):
                codes = row["code"].dictionary_encode(null_encoding="encode")
                kinds, code = codes.dictionary, np.asarray(codes.indices, np.int64)
                word = np.repeat(np.arange(len(row["words"])), np.diff(row["entry"][row["first"]]))
                cell, df = np.unique(word * max(1, len(kinds)) + code[row["docs"]], return_counts=True)
                word, code = np.divmod(cell, max(1, len(kinds)))
                yield pa.RecordBatch.from_arrays([kinds.take(pa.array(code)), row["words"].take(pa.array(word)), pa.array(df)], ["code", "word", "df"])

    cut = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("jurisdiction").alias("code"), F.col("vector").cast("array<float>").alias("vector"), words(F.coalesce("text", F.lit(""))).alias("w"))
    cut.mapInArrow(build, _DDL).write.option("maxRecordsPerFile", PER_FILE).parquet(f"{path}/batches")
    have = spark.read.schema(_DDL).parquet(f"{path}/batches")
    have.mapInArrow(frequencies, "code string, word string, df long").groupBy("code", "word").agg(F.sum("df").alias("df")).write.parquet(f"{path}/words")
    stats = _codes(have)
    row = (FORMAT, sum(r["n"] for r in stats), sum(r["n_vectors"] for r in stats), max((r["size"] for r in stats), default=0), k1, b, [(r["code"], r["n"], r["total"]) for r in stats])
    spark.createDataFrame([row], "format string, n_chunks long, n_vectors long, size int, k1 double, b double, codes array<struct<code:string,n:long,total:long>>").coalesce(1).write.parquet(f"{path}/manifest")
    return SearchIndex(spark, path)


def _codes(batches: DataFrame) -> list:
    """A row for each code of the chunks: n, total length, n_vectors, largest and smallest vector."""
    each = batches.select(F.explode(F.arrays_zip("code", "len", "size")).alias("c")).select("c.*")
    of = F.when(F.col("size") > 0, F.col("size"))
    return each.groupBy("code").agg(F.count("*").alias("n"), F.sum("len").alias("total"), F.count(of).alias("n_vectors"), F.coalesce(F.max(of), F.lit(0)).alias("size"), F.min(of).alias("smallest")).collect()


def rows_of(part: pa.RecordBatch):
    """The batches of a record batch: numpy arrays, but strings as Arrow arrays."""
    for i in range(part.num_rows):
        out = {}
        for c, t in _BATCH.items():
            x = part.column(c).slice(i, 1).flatten()
            out[c] = x if pa.types.is_string(t) else x.to_numpy()
        yield out


def check_index(spark: SparkSession, path: str) -> str | None:
    """What is wrong with the index at path, or None."""
    m = spark.read.parquet(f"{path}/manifest").collect()
    if len(m) != 1 or m[0]["format"] != FORMAT:
        return "formats differ"
    batches = spark.read.schema(_DDL).parquet(f"{path}/batches")
    stats = _codes(batches)
    if (sum(r["n"] for r in stats), sum(r["n_vectors"] for r in stats)) != (m[0]["n_chunks"], m[0]["n_vectors"]):
        return "counts differ"
    if m[0]["n_vectors"] and {r["size"] for r in stats if r["n_vectors"]} | {r["smallest"] for r in stats if r["n_vectors"]} != {m[0]["size"]}:
        return "vector sizes differ"
    entries = batches.agg(F.sum(F.size("docs"))).first()[0]
    if (entries or 0) != (spark.read.parquet(f"{path}/words").agg(F.sum("df")).first()[0] or 0):
        return "postings differ"
    return None


def open_index(spark: SparkSession, path: str, check: bool = True) -> SearchIndex:
    """The index at path; ValueError if its tables don't belong together."""
    if check and (wrong := check_index(spark, path)):
        raise ValueError(f"the index doesn't fit its manifest: {wrong}")
    return SearchIndex(spark, path)


class SearchIndex:
    """Tables of a written index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        small_batches(spark)
        m = spark.read.parquet(f"{path}/manifest").first()
        self.k1, self.b, self.n = m["k1"], m["b"], m["n_chunks"]
        self.codes = {r["code"]: (r["n"], r["total"]) for r in m["codes"]}
        self.batches, self.words = spark.read.schema(_DDL).parquet(f"{path}/batches"), spark.read.parquet(f"{path}/words")

    def pool(self, codes: list[str] | None) -> frozenset:
        """The codes of the chunks that a query with these codes looks at; empty: all of them, also where no chunk has its codes."""
        return frozenset(c.lower() for c in codes or []) & frozenset(self.codes)

    def sizes(self, pools: list[frozenset]) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, mean length) of each pool."""
        own = [[self.codes[c] for c in (p or self.codes)] for p in pools]
        n = np.array([sum(x[0] for x in rows) for rows in own], np.int64)
        total = np.array([sum(x[1] for x in rows) for rows in own], np.int64)
        return n, np.where(total > 0, total / np.maximum(n, 1), 1.0)

    def weights(self, pools: list[frozenset], asked: set[tuple[int, str]]) -> dict[tuple[int, str], float]:
        """{(pool, word): inverse frequency} of the asked pairs that the pool has; from the pool's own statistics, one pass over the words."""
        n, _ = self.sizes(pools)
        if not asked or not n.sum():
            return {}
        member = self.spark.createDataFrame([(c, k) for k, p in enumerate(pools) for c in (p or self.codes)], "member string, pool int")  # codes of a block of queries
        wanted = self.spark.createDataFrame([(*x, True) for x in asked], "pool int, word string, asked boolean")  # words of a block of queries
        size = F.element_at(F.array(*map(F.lit, n.tolist())), F.col("pool") + 1)
        df = self.words.join(F.broadcast(member), F.col("code").eqNullSafe(F.col("member"))).groupBy("pool", "word").agg(F.sum("df").alias("df"))
        raw = df.withColumn("raw", okapi_idf(F.col("df"), size)).join(F.broadcast(wanted), ["pool", "word"], "left")
        out = {}
        for r in raw.groupBy("pool").agg(F.avg("raw").alias("mean"), F.collect_list(F.when(F.col("asked"), F.struct("word", "raw"))).alias("found")).collect():
            out |= {(r["pool"], w): x if x >= 0 else 0.25 * r["mean"] for w, x in r["found"]}
        return out

    def bm25_top(self, queries: DataFrame, k: int, digits: int = 6, most_queries: int = 1000) -> DataFrame:
        """query_id, chunk_id, score, rank: the k chunks of the best BM25 score of each query of queries(query_id, text, codes) in its pool."""
        block = Block(self, queries, most_queries)

        def search(parts):
            searcher = Searcher(block, k, digits)
            for part in parts:
                for row in rows_of(part):
                    searcher(row)
            yield searcher.answers()

        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        found = self.batches.mapInArrow(search, "query_id long, chunk_id long, score double")
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


class Block:
    """One block of queries: words, pools and weights, without a reference to Spark, to be sent to tasks."""

    def __init__(self, index: SearchIndex, queries: DataFrame, most_queries: int = 1000):
        asked = queries.select("query_id", "codes", words(F.coalesce("text", F.lit(""))).alias("words")).limit(most_queries + 1).collect()
        if len(asked) > most_queries:
            raise ValueError(f"a block holds {most_queries} queries at most; deal them first")
        self.ids, self.k1, self.b = [r["query_id"] for r in asked], index.k1, index.b
        of = [index.pool(r["codes"]) for r in asked]
        self.pools = sorted(set(of), key=lambda p: sorted(map(str, p)))
        self.pool = np.array([self.pools.index(p) for p in of], np.int64)
        self.mean = index.sizes(self.pools)[1]
        times = {(q, w): c for q, r in enumerate(asked) for w, c in Counter(r["words"]).items()}
        idf = index.weights(self.pools, {(int(self.pool[q]), w) for q, w in times})
        weight = {(q, w): c * idf[self.pool[q], w] for (q, w), c in times.items() if (self.pool[q], w) in idf}
        self.vocabulary = sorted({w for _, w in weight})
        at = {w: k for k, w in enumerate(self.vocabulary)}
        own: dict[int, list] = {}
        for (q, w), x in sorted(weight.items()):
            own.setdefault(q, []).append((at[w], x))
        self.terms = [np.array([t for t, _ in own.get(q, [])], np.int64) for q in range(len(asked))]
        self.weights = [np.array([x for _, x in own.get(q, [])], np.float64) for q in range(len(asked))]

    def members(self, codes: pa.Array) -> np.ndarray:
        """(pool, chunk): whether the chunk belongs to the pool."""
        return np.array([np.ones(len(codes), bool) if not p else np.asarray(pc.is_in(codes, value_set=pa.array(sorted(p), pa.string()))) for p in self.pools]).reshape(len(self.pools), len(codes))

    def places(self, kinds: pa.Array) -> np.ndarray:
        """Where each word of the vocabulary stands among a batch's words, or -1."""
        return np.asarray(pc.index_in(pa.array(self.vocabulary, pa.string()), value_set=kinds).fill_null(-1), np.int64)


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the ranges, the range of each)."""
    size = last - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size), of


class Searcher:
    """The best k chunks of each query over the batches it is given; counts entries that the queries' words have, and those read."""

    def __init__(self, block: Block, k: int, digits: int = 6):
        self.block, self.k, self.digits = block, k, digits
        self.least = np.full(len(block.ids), -np.inf)
        self.kept = [(np.zeros(0, np.int64), np.zeros(0))] * len(block.ids)
        self.read = self.told = 0

    def __call__(self, batch: dict) -> None:
        block, n = self.block, len(batch["chunk_id"])
        at, members = block.places(batch["words"]), block.members(batch["code"])
        first, entry, docs, tfs, lengths = (batch[c].astype(np.int64) for c in ("first", "entry", "docs", "tfs", "len"))
        key = np.repeat(np.repeat(np.arange(len(first) - 1), np.diff(first)), np.diff(entry)) * n + docs
        order = np.argsort(key)  # by word and chunk
        key, tf_of = key[order], tfs[order]
        for q, (terms, weights) in enumerate(zip(block.terms, block.weights, strict=True)):
            here = at[terms] >= 0
            if not here.any():
                continue
            word, weight, mean = at[terms[here]], weights[here], block.mean[block.pool[q]]
            blocks, of = ranges(first[word], first[word + 1])
            bound = np.maximum(0.0, weight[of] * (block.k1 + 1) / (1 + block.k1 * (1 - block.b) / batch["most"][blocks] + block.k1 * block.b * batch["least"][blocks] / mean))
            # the bound of a word's blocks from this one on: each reading lowers the word's bound to that of the next block
            place = np.arange(len(blocks)) - np.concatenate([[0], np.cumsum(np.bincount(of))[:-1]])[of]
            grid = np.zeros((len(word), int(place.max()) + 2))
            grid[of, place] = bound
            grid = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
            order = np.lexsort((place, of, -grid[of, place]))
            total, left, sizes = grid[:, 0].sum(), grid[:, 0].sum() - np.cumsum((grid[of, place] - grid[of, place + 1])[order]), np.diff(entry)[blocks]
            self.told += int(sizes.sum())

            def exact(near):
                """Scores, taken from all words in their order, so that they don't depend on what was read."""
                wanted = word[:, None] * n + near  # noqa: B023
                spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)  # noqa: B023
                tf = np.where(key[spot] == wanted, tf_of[spot], 0)  # noqa: B023
                value = weight[:, None] * impact(np.maximum(tf, 1), lengths[near], mean, block.k1, block.b) * (tf > 0)  # noqa: B023
                return np.round(value.sum(axis=0), self.digits)

            def met(chosen):
                """(sums of the blocks' entries, whether a chunk of the pool was met)."""
                e, j = ranges(entry[blocks[chosen]], entry[blocks[chosen] + 1])  # noqa: B023
                score = weight[of[chosen][j]] * impact(tfs[e], lengths[docs[e]], mean, block.k1, block.b)  # noqa: B023
                seen = np.zeros(n, bool)  # noqa: B023
                seen[docs[e]] = True
                return np.bincount(docs[e], score, n), seen & members[block.pool[q]]  # noqa: B023

            if not np.isfinite(self.least[q]):
                # no threshold yet: that of the chunks in the blocks with the highest bounds, some times k of them
                some = np.flatnonzero(met(order[: int(np.searchsorted(np.cumsum(sizes[order]), 8 * self.k)) + 1])[1])
                if len(some) >= self.k:
                    self.least[q] = np.sort(exact(some))[-self.k]
            enough = np.flatnonzero(left < self.least[q] - ROOM)
            n_read = 0 if total < self.least[q] - ROOM else int(enough[0]) + 1 if len(enough) else len(blocks)
            if not n_read:
                continue
            self.read += int(sizes[order[:n_read]].sum())
            sums, seen = met(order[:n_read])
            near = np.flatnonzero(seen & (sums + (left[n_read - 1] if n_read < len(blocks) else 0.0) >= self.least[q] - ROOM))
            if len(near):
                self.offer(q, batch["chunk_id"][near], exact(near))

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        a, s = np.concatenate([self.kept[q][0], ids]), np.concatenate([self.kept[q][1], scores])
        top = np.lexsort((a, -s))[: self.k]
        self.kept[q] = a[top], s[top]
        if len(top) == self.k:
            self.least[q] = max(self.least[q], s[top[-1]])

    def answers(self) -> pa.RecordBatch:
        q = np.concatenate([np.full(len(a), i) for i, (a, _) in enumerate(self.kept)] or [np.zeros(0)]).astype(np.int64)
        ids, scores = (np.concatenate([x[j] for x in self.kept] or [np.zeros(0)]) for j in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(self.block.ids, pa.int64()).take(pa.array(q)), pa.array(ids, pa.int64()), pa.array(scores)], schema=_HITS)
