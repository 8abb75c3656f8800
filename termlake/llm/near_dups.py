"""Near-duplicate documents by circulant MinHash, with links confirmed on whole shingle sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes). One permutation of the
   hash universe scatters the set, a second one is shifted circularly by k to give signature
   coordinate k: sig[k] = min over the set of pi(sigma(x) + k mod 2^32).
2. Texts with equal sets are one class, led by its smallest doc_id (a partial aggregate, so a
   hot class costs one row per task). Rows learn their leader by a join on the set's digest; digests
   of over a 100,000th of all rows, of which there are 100,000 at most, are broadcast instead, so that
   no task gets all copies of a text. Only leaders go on.
3. `bands` bands of `rows` coordinates make buckets. With 20 x 5 a pair at similarity 0.85 is
   missed with probability 8e-6. Buckets with the same members are one bucket.
4. A bucket's texts go to one task, which compares full sets and returns a spanning forest of the
   confirmed links, never all pairs. A bucket of more than `block` texts or `block_shingles` shingles
   is first held, part by part, against its smallest text id: what links with it is one component
   already. Only the others, which a group of near copies has few of, are then compared in pairs of
   parts with each other and with those that did link; two parts that did are not.
5. Large-star/small-star passes join the links to components.

Defined cases: a text without words, or null, has an empty set and links with nothing; a text
with fewer words than a shingle is one shingle; rows that repeat a doc_id are taken as the same
document and each gets a result row; a row with null doc_id is compared with nothing and kept;
columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, WordHasher, chunks, columns, materialize, mix64, utf8

_M = [U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5)]


def shingle_sets(data: np.ndarray, off: np.ndarray, hasher: WordHasher, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    h, _, _, first = hasher(data, off)
    combined = h[: max(0, len(h) - width + 1)] * _M[0]
    for k in range(1, width):
        combined += h[k : k + len(combined)] * (_M[k % 5] + U64(2 * (k // 5)))
    combined = mix64(combined)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(combined[a : b - width + 1]))
        elif b > a:
            one = np.full(1, b - a, U64)
            for k, x in enumerate(h[a:b].reshape(-1, 1)):
                one = one * _M[3] + x * (_M[4] + U64(2 * k))
            out.append(mix64(one))
        else:
            out.append(np.zeros(0, U64))
    return out


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit universe."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Circulant MinHash signatures of non-empty sets, a row each."""
    out = np.empty((len(sets), n), np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 32768, side="right")) - 1)
        base = _scatter((np.concatenate(sets[a:b]) >> U64(32)).astype(np.uint32))
        v, t, at = np.empty_like(base), np.empty_like(base), bounds[a:b] - bounds[a]
        for k in range(n):
            np.add(base, np.uint32(k), out=v)  # the circular shift; the second permutation follows
            np.right_shift(v, np.uint32(16), out=t)
            v ^= t
            v *= np.uint32(0x7FEB352D)
            np.right_shift(v, np.uint32(15), out=t)
            v ^= t
            v *= np.uint32(0x846CA68B)
            np.right_shift(v, np.uint32(16), out=t)
            v ^= t
            out[a:b, k] = np.minimum.reduceat(v, at)
        a = b
    return out


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), keys (one hash per band; empty without words)."""

    def sketch(batches):
        hasher = WordHasher(SPACE_WORDS)
        salt = mix64(np.arange(1, bands + 1, dtype=U64))
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            data, off = utf8(texts)
            for a, b in chunks(off):
                sets = shingle_sets(data, off[a : b + 1], hasher, width)
                full = [s for s in sets if len(s)]
                sig = signatures(full, bands * rows).astype(U64).reshape(len(full), bands, rows)
                keys = np.tile(salt, (len(full), 1))
                for r in range(rows):
                    keys = mix64(keys * _M[2] + sig[:, :, r])
                it = iter(keys.view(np.int64).tolist())
                digest = [(int(s.sum(dtype=U64).astype(np.int64)), int(mix64(s.copy()).sum(dtype=U64).astype(np.int64))) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), pa.array([next(it) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "d1", "d2", "keys"],
                )

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def confirmed(sets: list[np.ndarray], percent: int) -> _Forest:
    """Components of texts (given as sets) under 100 * intersection >= percent * union."""
    n, forest = len(sets), _Forest(len(sets))
    sizes = np.fromiter(map(len, sets), np.int64, n)
    if n <= 24:
        for i in range(n):
            for j in range(i + 1, n):
                lo, hi = sorted((sizes[i], sizes[j]))
                if 100 * lo >= percent * hi and forest.root(i) != forest.root(j):
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (lo + hi - common):
                        forest.join(i, j)
        return forest
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column) > 1
    row = np.repeat(np.arange(n), sizes)
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 4096
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        x = np.zeros((n, step), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        common += x @ x.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        forest.join(int(i), int(j))
    return forest


def _sets(frame: pd.DataFrame, width: int) -> tuple[list[int], list[np.ndarray]]:
    """Ids in ascending order, each once, and their sets."""
    texts: dict[int, str] = {}
    for i, t in zip(frame["doc_id"], frame["text"], strict=True):
        texts.setdefault(int(i), t)
    hasher, ids = WordHasher(SPACE_WORDS), sorted(texts)
    sets: list[np.ndarray] = []
    data, off = utf8(pa.array([texts[i] for i in ids], pa.large_string()))
    for a, b in chunks(off):
        sets += shingle_sets(data, off[a : b + 1], hasher, width)
    return ids, sets


def _links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Spanning links (src, dst) of the confirmed links within each pair of blocks."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sets = _sets(frame, width)
        forest = confirmed(sets, percent)
        return pd.DataFrame([(ids[r], ids[i]) for i in range(len(ids)) if (r := forest.root(i)) != i], columns=["src", "dst"], dtype="int64")

    held = members.join(docs, "doc_id").select("key", "i", "j", "doc_id", "text")
    return held.groupBy("key", "i", "j").applyInPandas(compare, "src long, dst long")


def _stars(docs: DataFrame, big: DataFrame, banded: DataFrame, width: int, percent: int, few: bool) -> DataFrame:
    """key, src, dst: links of the texts of big(key, least, parts) buckets with the bucket's text of the smallest id.

    few: the buckets have so few rows that these can be sent to the texts.
    """

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        least = int(frame["least"].iloc[0])
        ids, sets = _sets(frame, width)
        own, found = sets[ids.index(least)], []
        for i, s in zip(ids, sets, strict=True):
            if i != least and 100 * min(len(s), len(own)) >= percent * max(len(s), len(own)):
                common = len(np.intersect1d(s, own, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(own) - common):
                    found.append((frame["key"].iloc[0], least, i))
        return pd.DataFrame(found, columns=["key", "src", "dst"], dtype="int64")

    dealt = banded.join(big, "key").select("key", "least", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("parts")).cast("int").alias("part"))
    first = big.select("key", "least", F.col("least").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = dealt.unionByName(first).distinct()
    held = docs.join(F.broadcast(held) if few else held, "doc_id")
    return held.groupBy("key", "part").applyInPandas(compare, "key long, src long, dst long")


def _across(inside: DataFrame, stars: DataFrame, n_parts) -> DataFrame:
    """key, doc_id, i, j: the pairs of parts of big buckets that are still to be compared. inside: the buckets' rows.

    First come the parts of texts that link with the smallest id, then those of the others.
    """
    inside = inside.join(stars.select("key", F.col("dst").alias("doc_id"), F.lit(True).alias("star")), ["key", "doc_id"], "left")
    inside = inside.withColumn("star", F.coalesce("star", F.col("doc_id") == F.col("least")))
    of = lambda star: F.when(F.col("star") == star, F.col("n_shingles"))
    counts = inside.groupBy("key").agg(*[f(of(s)).alias(f"{k}_{name}") for s, name in ((True, "star"), (False, "rest")) for k, f in (("n", F.count), ("total", F.sum))])
    ps, pr = n_parts(F.col("n_star"), F.col("total_star")), n_parts(F.col("n_rest"), F.col("total_rest"))
    dealt = inside.join(counts.filter("n_rest > 0").select("key", ps.alias("ps"), pr.alias("pr")), "key")
    h = F.xxhash64("doc_id", F.lit(1))
    own = F.when(F.col("star"), F.pmod(h, F.col("ps"))).otherwise(F.col("ps") + F.pmod(h, F.col("pr"))).cast("int")
    dealt = dealt.select("key", "doc_id", own.alias("own"), F.explode(F.sequence(F.when(F.col("star"), F.col("ps")).otherwise(0), F.col("ps") + F.col("pr") - 1)).alias("other"))
    return dealt.select("key", "doc_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _look_up(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """left with the columns of right(keys, n, ...), which has one row a key and in n how many of the `rows` of left have it.

    Keys of over a 100,000th of all rows, 100,000 at most, are broadcast, so that no task gets all rows of one key.
    """
    many = F.col("n") > max(1000, rows // 100_000)
    hot = F.broadcast(right.filter(many).drop("n"))
    rest = left.join(F.broadcast(right.filter(many).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(right.filter(~many).drop("n"), keys))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every end of an edge; component_id is the smallest id reachable.

    Large-star and small-star passes in turn; each is a partial aggregate for the smallest
    neighbour and a join back; a hub's neighbours are never gathered, in neither of the two.
    """
    edges = materialize(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while True:  # passes shorten every path, so this ends; a chain of n takes about log n of them
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = materialize(_look_up(both, least, ["u"], 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _look_up(large, least, ["u"], 2 * before[0])
        edges = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges"
        )
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("component_id"))
    return roots.select(F.col("u").alias("doc_id"), "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 20, rows: int = 5, block: int = 512, block_shingles: int = 1 << 19) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialize(sketches(slim, width, bands, rows), "sketches")
    leaders = sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n"))
    leaders = materialize(leaders, "leaders")
    heads = leaders.select(F.col("leader").alias("doc_id")).distinct()
    banded = (
        sketch.join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        .select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    )
    banded = materialize(banded, "bands")
    buckets = (
        banded.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who"), F.sum("n_shingles").alias("total"))
        .filter("n > 1")
        .groupBy("n", "least", "who").agg(F.min("key").alias("key"), F.max("total").alias("total"))
    )
    whole = (F.col("n") <= block) & (F.col("total") <= block_shingles)
    n_parts = lambda n, total: F.ceil(F.greatest(n / (block / 2), total / (block_shingles / 2)) - 1e-9).cast("int")
    buckets = materialize(buckets.select("key", "least", "n", F.when(whole, 1).otherwise(n_parts(F.col("n"), F.col("total"))).alias("parts")), "buckets")
    members = banded.join(buckets.filter("parts = 1"), "key").select("key", "doc_id", F.lit(0).alias("i"), F.lit(0).alias("j"))
    n_big = buckets.filter("parts > 1").agg(F.sum("n")).first()[0] or 0
    links = None
    if n_big:
        big = buckets.filter("parts > 1").drop("n")
        stars = materialize(_stars(slim, big, banded, width, percent, n_big <= 100_000), "stars")
        links = stars.select("src", "dst")
        members = members.unionByName(_across(banded.join(big, "key"), stars, n_parts))
    found = _links(slim, members, width, percent)
    links = found if links is None else found.unionByName(links)
    comps = components(links).withColumnRenamed("doc_id", "leader")
    classes = materialize(leaders.join(comps, "leader", "left").select("d1", "d2", "n", F.coalesce("component_id", "leader").alias("component")), "classes")
    known = sketch.select("doc_id", "n_shingles", "d1", "d2")
    lone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)  # these have no class
    every = _look_up(known.filter(~lone), classes, ["d1", "d2"], sketch.count()).unionByName(known.filter(lone).withColumn("component", F.col("doc_id")))
    return every.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
