"""Exact ranked lexical search: posting lists in blocks of similar documents, skipped by coordinatewise maxima.

Items are the small side and come in batches of at most `most_items` items and about `most_terms` distinct terms. For a
batch, documents are reduced once to vectors over its terms; everything else reads these.

1. Statistics (N, L, document frequencies, each term's largest value) are sums and maxima over all vectors.
2. A bounded sample of documents, chosen by hash, is scored in full. An item's k-th score there is a lower bound of its
   final k-th score. Terms whose largest contributions together stay below it can't lift a document over it by
   themselves; the item's other terms are its essential ones, and only their posting lists are kept.
3. Documents are dealt by their most similar pivots (documents of the sample) and cut into shards of similar ones. In a
   shard each term's posting list is clustered once more: every 32nd document of the list is a centre, each document goes
   to the centre with which its vector agrees best, clusters are cut into blocks of 32 at most. A block stores, for each
   term that its term is asked together with, the largest value of its documents. The shards are the index, a table.
4. A block is skipped only if the weighted sum of its maxima is below the item's threshold (the sample's, or the k-th
   score that the task has seen, where that is higher). Documents of the other blocks are scored in full from their
   vectors. A task keeps k documents an item; equal scores are never cut by a bound.

An item's terms beyond its `coordinates` strongest are bounded by their largest value anywhere instead of the block's. All
sums are whole numbers below 2^53, so nothing is rounded. Terms are told apart by 64-bit hashes: that two of 10^7 kinds
of words and 16,000 asked ones share one has a chance below 10^-8.

Defined cases: null and empty texts have no terms, such documents count nowhere and such items have no rows; documents
without a doc_id can't be told and count nowhere either; repeated rows of documents and of items are documents and items
of their own; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PLAIN_WORDS, U64, WordHasher, chunks, columns, held, materialize, small_batches, utf8

_INDEX = [("docs", pa.int64()), ("ptr", pa.int32()), ("terms", pa.int32()), ("vals", pa.int32()), ("block_term", pa.int32()), ("block_ptr", pa.int32()), ("block_docs", pa.int32()), ("maxima", pa.int32())]
_HITS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
_HITS_DDL = "item int, doc_id long, score long"


def value(tf, m):
    """A term's value in a document, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Batch:
    """Items of one batch: their terms as numbers of a common vocabulary, later weights, thresholds, essential terms."""

    def __init__(self, ids: list, hashes: list[np.ndarray]):
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
        self.terms = [np.searchsorted(self.vocabulary, h) for h in hashes]
        self.size = len(self.vocabulary)

    def weigh(self, n: int, length: int, df: np.ndarray, most: np.ndarray) -> None:
        self.n, self.length = n, length
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.float64)
        self.bound = self.weight * most

    def plan(self, threshold: np.ndarray, coordinates: int) -> None:
        """threshold: of each item, 0 where there is none."""
        self.threshold = threshold
        self.essential, asked_with, strong = [], {}, []
        for t, least in zip(self.terms, threshold, strict=True):
            up = t[np.argsort(self.bound[t], kind="stable")]
            free = int(np.searchsorted(np.cumsum(self.bound[up]), max(least, 1), side="left"))
            self.essential.append(up[free:][::-1])
            strong.append(np.sort(up[::-1][:coordinates]))
            for x in self.essential[-1].tolist():
                asked_with.setdefault(x, []).append(strong[-1])
        self.axes = {t: np.unique(np.concatenate(x)) for t, x in asked_with.items()}
        # what an item's terms that have no axis can add
        self.rest = [float(self.bound[t].sum() - self.bound[s].sum()) for t, s in zip(self.terms, strong, strict=True)]
        self.strong = strong


def batches_of(items: DataFrame, most_items: int, most_terms: int):
    """Batches of items(item_id, text), read from the driver one after the other."""
    hasher, ids, hashes, kinds = WordHasher(PLAIN_WORDS), [], [], set()
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").toLocalIterator():
        raw, off = utf8(pa.array([r["text"]], pa.string()))
        own = np.unique(hasher(raw, off)[0])
        if not len(own):
            continue
        if ids and (len(ids) >= most_items or len(kinds | set(own.tolist())) > most_terms):
            yield Batch(ids, hashes)
            ids, hashes, kinds = [], [], set()
        ids.append(r["item_id"])
        hashes.append(own)
        kinds |= set(own.tolist())
    if ids:
        yield Batch(ids, hashes)


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs (of the vocabulary) of every document with a term."""

    def cut(batches):
        hasher, size = WordHasher(PLAIN_WORDS), len(vocabulary)
        for table in held(batches, 4 << 20):
            ids = table["doc_id"].combine_chunks()
            raw, off = utf8(table["text"].combine_chunks())
            for a, b in chunks(off):
                hashes, _, _, first = hasher(raw, off[a : b + 1])
                at = np.searchsorted(vocabulary, hashes)
                at[at == size] = 0
                hit = np.flatnonzero(vocabulary[at] == hashes)
                of = np.repeat(np.arange(b - a), np.diff(first))[hit]
                cell, tf = np.unique(of * size + at[hit], return_counts=True)
                row, term = np.divmod(cell, size)
                ptr = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ptr), pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(first)), *lists], ["doc_id", "n", "terms", "tfs"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return slim.mapInArrow(cut, "doc_id long, n long, terms array<int>, tfs array<int>").filter("n > 0")


class Rows:
    """Vectors of some documents with values instead of counts."""

    def __init__(self, table: pa.Table | pa.RecordBatch, n: int, length: int):
        if isinstance(table, pa.RecordBatch):
            table = pa.Table.from_batches([table])
        self.ids = table["doc_id"].to_numpy()
        terms = table["terms"].combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = terms.flatten().to_numpy().astype(np.int64)
        m = 50 + (50 * table["n"].to_numpy() * n) // length
        self.of = np.repeat(np.arange(len(self.ids)), sizes)
        self.vals = value(table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64), m[self.of])

    def dense(self, size: int, columns: np.ndarray | None = None) -> np.ndarray:
        x = np.zeros((len(self.ids), size), np.int32)
        x[self.of, self.terms] = self.vals
        return x

    def project(self, table: np.ndarray) -> np.ndarray:
        """The vectors times table(term, column)."""
        out = np.zeros((len(self.ids), table.shape[1]), np.float32)
        for a in range(0, len(self.ids), 256):
            b = min(a + 256, len(self.ids))
            lo, hi = self.ptr[a], self.ptr[b]
            part, at = table[self.terms[lo:hi]] * self.vals[lo:hi, None].astype(np.float32), self.ptr[a:b] - lo
            full = np.flatnonzero(np.diff(self.ptr[a : b + 1]))
            if len(full):
                out[a + full] = np.add.reduceat(part, at[full], axis=0)
        return out


class Best:
    """The best k documents of each item among those that were offered."""

    def __init__(self, n_items: int, k: int, threshold: np.ndarray):
        self.k, self.threshold = k, threshold.astype(np.float64).copy()
        self.kept = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(n_items)]

    def offer(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores > 0) & (scores >= self.threshold[item])
        if not ok.any():
            return
        a, s = np.concatenate([self.kept[item][0], ids[ok]]), np.concatenate([self.kept[item][1], scores[ok]])
        top = np.lexsort((a, -s))[: self.k]
        self.kept[item] = a[top], s[top]
        if len(top) == self.k:
            self.threshold[item] = max(self.threshold[item], s[top[-1]])

    def batch(self) -> pa.RecordBatch:
        item = np.concatenate([np.full(len(a), q) for q, (a, _) in enumerate(self.kept)])
        ids, scores = (np.concatenate([x[j] for x in self.kept]) for j in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids), pa.array(scores.astype(np.int64))], schema=_HITS)


def build_shard(rows: Rows, batch: Batch, block: int, sketch: np.ndarray) -> dict[str, np.ndarray]:
    """The index of one shard: its vectors, and the blocks of the posting lists that some item needs."""
    x, y = rows.dense(batch.size), rows.project(sketch)
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    order = np.lexsort((rows.of, rows.terms))
    terms, of = rows.terms[order], rows.of[order]
    cut = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    block_term, sizes, listed, maxima = [], [], [], []
    for a, b in itertools.pairwise(np.append(cut, len(terms))):  # none, if no document of the shard has an asked term
        axes = batch.axes.get(int(terms[a]))
        if axes is None:
            continue
        docs, starts = of[a:b], np.zeros(1, np.int64)
        if len(docs) > block:
            centre = (y[docs] @ y[docs[::block]].T).argmax(axis=1)
            order = np.argsort(centre, kind="stable")
            docs, centre = docs[order], centre[order]
            new = np.concatenate([[True], centre[1:] != centre[:-1]])
            within = np.arange(len(docs)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            starts = np.flatnonzero(within % block == 0)
        maxima.append(np.maximum.reduceat(x[docs][:, axes], starts, axis=0).ravel())
        block_term += [int(terms[a])] * len(starts)
        sizes.append(np.diff(np.append(starts, len(docs))))
        listed.append(docs)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return {
        "docs": rows.ids, "ptr": rows.ptr, "terms": rows.terms, "vals": rows.vals, "block_term": np.array(block_term, np.int64),
        "block_ptr": np.concatenate([[0], np.cumsum(join(sizes))]), "block_docs": join(listed), "maxima": join(maxima),
    }


class Searcher:
    """Answers a batch of items shard by shard; counts blocks told and blocks read."""

    def __init__(self, batch: Batch, k: int):
        self.batch, self.best = batch, Best(len(batch.ids), k, batch.threshold)
        self.told = self.read = 0

    def __call__(self, shard: dict[str, np.ndarray]) -> None:
        batch, ids, ptr = self.batch, shard["docs"], shard["ptr"].astype(np.int64)
        x = np.zeros((len(ids), batch.size), np.int32)
        x[np.repeat(np.arange(len(ids)), np.diff(ptr)), shard["terms"]] = shard["vals"]
        terms, first = np.unique(shard["block_term"], return_index=True)
        ends = np.append(first, len(shard["block_term"])).tolist()  # the shard may have no list that an item needs
        lists, at = {}, 0
        for t, (a, b) in zip(terms.tolist(), itertools.pairwise(ends), strict=True):
            axes = batch.axes[t]
            lists[t] = (a, b, axes, shard["maxima"][at : at + (b - a) * len(axes)].reshape(b - a, len(axes)))
            at += (b - a) * len(axes)
        block_ptr, block_docs = shard["block_ptr"].astype(np.int64), shard["block_docs"]
        for q in range(len(batch.ids)):
            wanted = np.zeros(len(ids), bool)
            strong = batch.strong[q]
            for t in batch.essential[q].tolist():
                if t not in lists:
                    continue
                a, b, axes, maxima = lists[t]
                bound = maxima[:, np.searchsorted(axes, strong)].astype(np.float64) @ batch.weight[strong] + batch.rest[q]
                kept = a + np.flatnonzero((bound > 0) & (bound >= self.best.threshold[q]))
                self.told += b - a
                self.read += len(kept)
                for i in kept.tolist():
                    wanted[block_docs[block_ptr[i] : block_ptr[i + 1]]] = True
            found = np.flatnonzero(wanted)
            if len(found):
                own = batch.terms[q]
                self.best.offer(q, ids[found], x[np.ix_(found, own)].astype(np.float64) @ batch.weight[own])


def _thresholds(sample: DataFrame, shared, k: int, n_items: int) -> np.ndarray:
    """The k-th score of each item among the documents of the sample; 0 where it has fewer."""

    def score(batches):
        batch = shared.value
        best = Best(n_items, k, np.zeros(n_items))
        for part in batches:
            for a in range(0, part.num_rows, 512):
                rows = Rows(part.slice(a, 512), batch.n, batch.length)
                x = rows.dense(batch.size)
                for q, own in enumerate(batch.terms):
                    best.offer(q, rows.ids, x[:, own].astype(np.float64) @ batch.weight[own])
        yield best.batch()

    w = Window.partitionBy("item").orderBy(F.desc("score"))
    out = np.zeros(n_items)
    for r in sample.mapInArrow(score, _HITS_DDL).withColumn("place", F.row_number().over(w)).filter(F.col("place") == k).collect():
        out[r["item"]] = r["score"]
    return out


def search_batch(docs: DataFrame, batch: Batch, k: int, sample: int, pivots: int, shard_docs: int, block: int, coordinates: int) -> DataFrame:
    """item_id, item (its place in the batch), doc_id, score, rank."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], f"item_id long, {_HITS_DDL}, rank int")
    table = materialize(vectors(docs, batch.vocabulary), "search-vectors")
    sums = table.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
    if not sums["n"]:
        return empty
    n, length = int(sums["n"]), int(sums["length"])
    m = F.lit(50) + F.expr(f"(50 * n * {n}L) div {length}L")
    cell = table.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("c")).select(F.col("c.terms").alias("term"), F.col("c.tfs").cast("long").alias("tf"), "m")
    stats = cell.groupBy("term").agg(F.count("*").alias("df"), F.max(F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")).alias("most"))
    df, most = np.zeros(batch.size, np.int64), np.zeros(batch.size)
    for r in stats.collect():  # a row for each term of the batch
        df[r["term"]], most[r["term"]] = r["df"], r["most"]
    batch.weigh(n, length, df, most)

    shared = spark.sparkContext.broadcast(batch)
    share = min(1.0, sample / n)
    chosen = table.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20))))
    batch.plan(_thresholds(chosen, shared, k, len(batch.ids)), coordinates)
    shared.unpersist()

    shared = spark.sparkContext.broadcast(batch)
    heads = chosen.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(pivots).select("doc_id", "n", "terms", "tfs").toArrow()
    centre = (Rows(heads, n, length).dense(batch.size) * batch.weight).T.astype(np.float32)
    centre /= np.maximum(np.linalg.norm(centre, axis=0, keepdims=True), 1e-9)
    centre *= batch.weight[:, None].astype(np.float32)
    axis = np.random.default_rng(13).choice([-1.0, 1.0], (batch.size, 128)).astype(np.float32) * batch.weight[:, None].astype(np.float32)
    geometry = spark.sparkContext.broadcast((centre, axis))

    def near(parts):
        for part in parts:
            like = Rows(part, n, length).project(geometry.value[0])
            first = like.argmax(axis=1)
            like[np.arange(len(like)), first] = -1
            codes = [pa.array(x.astype(np.int32)) for x in (first, like.argmax(axis=1))]
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id", "n", "terms", "tfs"), *codes], ["doc_id", "n", "terms", "tfs", "code", "code2"])

    def index(parts):
        def emit(rows):
            shard = build_shard(Rows(rows, n, length), shared.value, block, geometry.value[1])
            return pa.RecordBatch.from_arrays([pa.array([shard[c]], pa.list_(kind)) for c, kind in _INDEX], [c for c, _ in _INDEX])

        kept, size = [], 0
        for part in parts:
            at = 0
            while at < part.num_rows:
                piece = part.slice(at, shard_docs - size)
                kept.append(piece)
                at, size = at + piece.num_rows, size + piece.num_rows
                if size == shard_docs:
                    yield emit(pa.Table.from_batches(kept))
                    kept, size = [], 0
        if size:
            yield emit(pa.Table.from_batches(kept))

    kinds = {pa.int64(): "long", pa.int32(): "int"}
    coded = table.mapInArrow(near, "doc_id long, n long, terms array<int>, tfs array<int>, code int, code2 int")
    # tasks of 16 shards each; past 20,000 tasks they hold more shards instead
    dealt = coded.repartitionByRange(min(max(8, n // (16 * shard_docs)), 20_000), "code", "code2", "doc_id").sortWithinPartitions("code", "code2", "doc_id")
    shards = materialize(dealt.mapInArrow(index, ", ".join(f"{c} array<{kinds[t]}>" for c, t in _INDEX)), "search-index", group_rows=2)

    def search(parts):
        searcher = Searcher(shared.value, k)
        for part in parts:
            for i in range(part.num_rows):
                searcher({c: part.column(j).slice(i, 1).flatten().to_numpy() for j, (c, _) in enumerate(_INDEX)})
        found = searcher.best.batch()
        # named here: a join with the names would be a broadcast that may wait for all of the search, longer than Spark lets it
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids, pa.int64()).take(found.column(0)), *found.columns], ["item_id", *_HITS.names])

    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return shards.select(*[c for c, _ in _INDEX]).mapInArrow(search, f"item_id long, {_HITS_DDL}").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, most_items: int = 500, most_terms: int = 1 << 14, sample: int = 8192, pivots: int = 64, shard_docs: int = 1000, block: int = 32, coordinates: int = 128
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs(doc_id, text) for each row of items(item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for batch in batches_of(items, most_items, most_terms):
        found = search_batch(docs, batch, k, sample, pivots, max(16, min(shard_docs, (1 << 23) // batch.size)), block, coordinates)
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out
