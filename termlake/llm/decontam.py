"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document, as search engines do it: a segment is a block of
documents with, for every term, the sorted positions at which it stands. Segments are rows of
a table in the shared folder, so a query block reads them without a shuffle and a lost executor
costs one segment. A benchmark window (`width` consecutive words; a shorter item is one window)
is looked up by its rarest term in the segment; that term's posting list, moved by its offset in
the window, is then intersected with the lists of the next rarest terms. What is left are exact
phrase matches. With `slack` > 0 a window also matches where its terms stand in order with at
most `slack` foreign words between neighbours (proximity): all postings in reach are followed, from
those of the rarest term outwards.

The benchmark is the stated query set: its distinct windows are written in blocks of about
`block_windows` to the shared folder, and a task that holds a segment reads one block after the
other; neither the driver nor a task ever holds all of them, and the index is read once.
Defined cases: null text has no words; an item without words has no window; null doc_id stays
null; repeated rows give repeated results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORDS, WordHasher, chunks, columns, materialize, utf8
from .token_files import file_system

_INDEX = "segment long, doc_ids binary, null_ids binary, firsts binary, terms binary, term_first binary, positions binary"


def build_index(docs: DataFrame, segment_bytes: int = 8 << 20) -> DataFrame:
    """One row per segment: document ids, each one's first word, the terms and their positions."""

    def segments(batches):
        from pyspark import TaskContext

        hasher, k = WordHasher(PLAIN_WORDS), 0
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            data, off = utf8(texts)
            for a, b in chunks(off, segment_bytes):
                words, firsts, total = [], [np.zeros(1, np.int64)], 0
                part = off[a : b + 1]
                for c, d in chunks(part):
                    h, _, _, first = hasher(data, part[c : d + 1])
                    words.append(h)
                    firsts.append(first[1:] + total)
                    total += len(h)
                words = np.concatenate(words) if words else np.zeros(0, np.uint64)
                order = np.argsort(words, kind="stable").astype(np.int32)
                ranked = words[order]
                new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
                own = ids.slice(a, b - a)
                row = [base + k, np.asarray(own.fill_null(0), np.int64).tobytes(), np.asarray(own.is_null(), bool).tobytes(), np.concatenate(firsts).tobytes(), ranked[new].tobytes(), np.append(new, len(ranked)).tobytes(), order.tobytes()]
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] + [pa.binary()] * 6, strict=True)], ["segment", "doc_ids", "null_ids", "firsts", "terms", "term_first", "positions"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(segments, _INDEX)


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, words as binary of 64-bit hashes) for each distinct window."""

    def cut(batches):
        hasher = WordHasher(PLAIN_WORDS)
        for batch in batches:
            ids, texts = columns(batch, "item_id", "text")
            data, off = utf8(texts)
            items, out = [], []
            for a, b in chunks(off):
                h, _, _, first = hasher(data, off[a : b + 1])
                for i in range(b - a):
                    w = h[first[i] : first[i + 1]]
                    for s in range(max(1, len(w) - width + 1) if len(w) else 0):
                        items.append(ids[a + i].as_py())
                        out.append(w[s : s + width].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.binary())], ["item_id", "words"])

    slim = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut, "item_id string, words binary").distinct()


class Segment:
    """A segment of the index in memory, with its postings and the term at each position."""

    def __init__(self, row: dict):
        get = lambda k, t: np.frombuffer(row[k], t)
        self.ids, self.nulls, self.firsts = get("doc_ids", np.int64), get("null_ids", bool), get("firsts", np.int64)
        self.terms, self.term_first, self.positions = get("terms", np.uint64), get("term_first", np.int64), get("positions", np.int32)
        self.at = np.empty(len(self.positions), np.int32)
        self.at[self.positions] = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.term_first))
        self.doc_end = np.repeat(self.firsts[1:], np.diff(self.firsts))

    def phrases(self, lengths: np.ndarray, words: np.ndarray):
        """(window, position) of each exact occurrence. words: a row of hashes per window, padded with 0."""
        if not len(self.terms) or not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        used = np.arange(words.shape[1]) < lengths[:, None]
        size = np.where(self.terms[rank] == words, np.diff(self.term_first)[rank], 0)
        alive = np.flatnonzero(np.where(used, size > 0, True).all(1))
        order = np.argsort(np.where(used, size, np.iinfo(np.int64).max)[alive], axis=1, kind="stable")
        rarest = order[:, 0]
        lists = rank[alive, rarest]
        sizes = np.diff(self.term_first)[lists]
        which = np.repeat(np.arange(len(alive)), sizes)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = self.positions[np.repeat(self.term_first[:-1][lists], sizes) + inner].astype(np.int64) - np.repeat(rarest, sizes)
        keep = at >= 0
        which, at = which[keep], at[keep]
        keep = at < len(self.at)
        which, at = which[keep], at[keep]
        keep = at + lengths[alive][which] <= self.doc_end[at]
        which, at = which[keep], at[keep]
        for k in range(1, words.shape[1]):
            offset = order[which, k]
            own = used[alive[which], offset]
            there = self.at[np.where(own, at + offset, 0)]
            keep = ~own | (there == rank[alive[which], offset])
            which, at = which[keep], at[keep]
        return alive[which], at

    def near(self, lengths: np.ndarray, words: np.ndarray, slack: int):
        """(window, start, end) where a window's terms stand in order, neighbours at most slack + 1 apart.

        From each posting of the rarest term all postings in reach are kept, outwards to both ends of
        the window; what is returned for it spans every chain that runs through it.
        """
        found, sizes, gap = [], np.diff(self.term_first), slack + 2
        doc = np.searchsorted(self.firsts, self.positions, side="right") - 1
        spread = self.positions + doc * gap  # no neighbours across documents
        for w in range(len(lengths)):
            rank = np.minimum(np.searchsorted(self.terms, words[w, : lengths[w]]), max(0, len(self.terms) - 1))
            if not len(self.terms) or not len(rank) or (self.terms[rank] != words[w, : lengths[w]]).any():
                continue
            lists = [spread[self.term_first[r] : self.term_first[r + 1]] for r in rank]
            k = int(np.argmin(sizes[rank]))
            end, ahead = _farthest(lists[k:], slack + 1)
            start, behind = (x[::-1] for x in _farthest([-x[::-1] for x in lists[k::-1]], slack + 1))
            ok = ahead & behind
            back = doc[self.term_first[rank[k]] : self.term_first[rank[k] + 1]][ok] * gap
            found.append(np.stack([np.full(int(ok.sum()), w), -start[ok] - back, end[ok] - back + 1], axis=1))
        a = np.concatenate([np.zeros((0, 3), np.int64), *found]).astype(np.int64)
        return a[:, 0], a[:, 1], a[:, 2]


def _farthest(lists: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of lists[0]: the farthest end of chains that take one value of each list, each at most `reach` above the one before; whether there is any."""
    kept = [lists[0].astype(np.int64)]
    for nxt in lists[1:]:
        lo, hi = np.searchsorted(nxt, kept[-1], side="right"), np.searchsorted(nxt, kept[-1] + reach, side="right")
        n = hi - lo
        kept.append(nxt[np.unique(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))].astype(np.int64))
    far, ok = kept[-1], np.ones(len(kept[-1]), bool)
    for cur, nxt in zip(kept[-2::-1], kept[:0:-1], strict=True):
        if not len(nxt):
            return np.zeros(len(kept[0]), np.int64), np.zeros(len(kept[0]), bool)
        # of the values in reach that lead to an end, the last leads farthest
        last = np.maximum.accumulate(np.where(ok, np.arange(len(nxt)), -1))
        lo, hi = np.searchsorted(nxt, cur, side="right"), np.searchsorted(nxt, cur + reach, side="right")
        j = np.where(hi > 0, last[np.maximum(hi - 1, 0)], -1)
        ok, far = j >= lo, far[np.maximum(j, 0)]
    return far, ok


def _merge(starts, ends):
    """Union of intervals as sorted disjoint ones."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return s[new], e[last]


def _block(uri: str) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Lengths, words (a row of hashes per window, padded with 0) and items of a block of windows."""
    import pyarrow.parquet as pq

    fs, path = file_system(uri)
    t = pq.read_table(path, filesystem=fs, columns=["words", "items"])
    block = [np.frombuffer(w, np.uint64) for w in t["words"].to_pylist()]
    lengths = np.array([len(w) for w in block], np.int64)
    words = np.zeros((len(block), max(lengths, default=1)), np.uint64)
    for i, w in enumerate(block):
        words[i, : len(w)] = w
    return lengths, words, [sorted(x) for x in t["items"].to_pylist()]


def _search(index: DataFrame, blocks: list[str], slack: int) -> DataFrame:
    def search(batches):
        kept = _block(blocks[0]) if len(blocks) == 1 else None
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                hits: list[set] = [set() for _ in seg.ids]
                starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for uri in blocks:
                    lengths, words, items = kept or _block(uri)
                    if slack:
                        w, s, e = seg.near(lengths, words, slack)
                    else:
                        w, s = seg.phrases(lengths, words)
                        e = s + lengths[w]
                    starts.append(s)
                    ends.append(e)
                    doc = np.searchsorted(seg.firsts, s, side="right") - 1
                    for i, k in np.unique(np.stack([doc, w], axis=1), axis=0).tolist() if len(w) else ():
                        hits[i].update(items[k])
                s, e = np.concatenate(starts), np.concatenate(ends)
                doc = np.searchsorted(seg.firsts, s, side="right") - 1
                order = np.argsort(doc, kind="stable")
                s, e = s[order], e[order]
                cut = np.searchsorted(doc[order], np.arange(len(seg.ids) + 1))
                spans, n_hit = [], []
                for i in range(len(seg.ids)):
                    a, b = cut[i], cut[i + 1]
                    s1, e1 = _merge(s[a:b] - seg.firsts[i], e[a:b] - seg.firsts[i]) if a < b else (s[:0], e[:0])
                    spans.append([{"a": int(x), "b": int(y)} for x, y in zip(s1, e1, strict=True)])
                    n_hit.append(int((e1 - s1).sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seg.ids, pa.int64(), mask=seg.nulls), pa.array(np.diff(seg.firsts), pa.int64()), pa.array(n_hit, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([sorted(h) for h in hits], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "n_hit", "spans", "items"],
                )

    return index.mapInArrow(search, "doc_id long, n_words long, n_hit long, spans array<struct<a:int,b:int>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, one_in: int = 20, slack: int = 0, block_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word positions), items (sorted item ids), contaminated."""
    index = materialize(build_index(docs), "postings")
    windows = materialize(windows_of(benchmark, width).groupBy("words").agg(F.collect_set("item_id").alias("items")), "windows")
    n = max(1, -(-windows.count() // block_windows))
    blocks = materialize(windows.repartition(n, "words"), "blocks") if n > 1 else materialize(windows.coalesce(1), "blocks")
    found = _search(index, sorted(blocks.inputFiles()), slack)
    return found.select("doc_id", "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"))
