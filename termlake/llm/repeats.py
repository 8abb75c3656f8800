"""Repeated passages, found byte for byte with sharded suffix arrays.

Every byte is removed that a string of `length` bytes covers which also starts earlier in the
corpus (smaller doc_id, or the same text at a smaller offset). The work is cut so that all
occurrences of such a string meet in one shard, and only text that may repeat gets there:

1. In each window of `length` bytes the 32-byte gram with the smallest hash is its anchor: equal
   windows have equal anchors at equal offsets. Anchors (one per 35 bytes) go to buckets by hash;
   a bucket tells which anchors stand at two places or more, and in which documents.
2. Those documents, and no others, are read again. The windows of an anchor that repeats make one
   snippet; snippets go, packed, to the shard of their anchor.
3. A shard joins its distinct snippets, builds their suffix array by induced sorting, and takes
   common prefixes of `length` bytes from the permuted prefix array: suffixes that share one are
   occurrences of one window. All but the first are removed. Snippets of one anchor stay together;
   a bucket is sorted in parts of some anchors each.
4. An anchor with more than `hot` occurrences could make a shard too large. Its windows are dealt
   one by one, by the hash of the window, after each task has removed all but its own first one;
   so a passage that a third of the corpus shares costs one entry per task.

There is a bucket for every `bucket` bytes of text, whatever the session's settings, and a block
of documents sends a bucket one row for its snippets and one for its hot windows: at most as many
rows as it has anchors or hot windows, so the exchange grows with the text.

Anchor and window hashes only decide where text goes; on the hot path windows are compared by two
64-bit hashes (that any two of 10^14 different windows share both has a chance under 2e-11). Rows that repeat a doc_id are one document: a text isn't earlier than itself.
Defined cases: null counts as empty; texts shorter than `length` keep everything; a row with null
doc_id is kept whole and repeats nothing; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, columns, held, materialize, mix64, small_batches, utf8
from .suffix_array import common_prefixes, suffix_array

GRAM = 32
_STEP, _STEP2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SHARD_BYTES = 1 << 18
PART_BYTES = 3 << 20


class Roller:
    """Hashes of all substrings of one size of a chunk, from prefix sums."""

    def __init__(self, step: int, seed: int):
        self.step, self.unstep = U64(step), U64(pow(step, -1, 1 << 64))
        self.letters = mix64(np.arange(1, 257, dtype=U64) * U64(0xC2B2AE3D27D4EB4F) + U64(seed))
        self.powers = self.unpowers = np.ones(1, U64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if len(self.powers) <= n:
            s = np.full(max(n + 1, 1 << 20), self.step)
            s[0] = U64(1)
            self.powers = np.cumprod(s, dtype=U64)
            s[1:] = self.unstep
            self.unpowers = np.cumprod(s, dtype=U64)
        out = np.zeros(n + 1, U64)
        np.cumsum(self.letters[raw] * self.powers[:n], out=out[1:])
        return out

    def at(self, sums: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
        return mix64((sums[where + size] - sums[where]) * self.unpowers[where])

    def all(self, sums: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        return mix64((sums[size:] - sums[:-size]) * self.unpowers[:n]) if n > 0 else np.zeros(0, U64)


def anchors(raw: np.ndarray, off: np.ndarray, length: int, roller: Roller):
    """(hash, first window, number of windows, text) of each run of windows with one anchor."""
    n, none = len(raw), np.zeros(0, np.int64)
    rel = off - off[0]
    if n < length or not (np.diff(rel) >= length).any():
        return none.astype(U64), none, none, none
    grams = roller.all(roller.sums(raw), GRAM)
    bits = U64(max(1, int(len(grams)).bit_length()))
    key = ((grams >> bits) << bits) | np.arange(len(grams), dtype=U64)
    span, least, have = length - GRAM + 1, key, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    inside = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(rel) >= length)
    np.add.at(inside, rel[long], 1)
    np.add.at(inside, rel[long + 1] - length + 1, -1)
    where = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    at = (least[where] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)]))
    start = where[new]
    return grams[at[new]], start, np.diff(np.append(new, len(where))), np.searchsorted(rel, start, side="right") - 1


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _by_bucket(h: np.ndarray, n: int):
    """(bucket, indices) for each bucket of the hashes; indices ascend by hash. Anchors are the smallest of
    many hashes, so their upper bits are mostly zero: hashes are mixed once more to deal them evenly."""
    if not len(h):
        return
    b = _bucket(mix64(h + U64(0x9E3779B97F4A7C15)), n)
    order = np.lexsort((h, b))
    b = b[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for lo, hi in zip(cut, np.append(cut[1:], len(b)), strict=True):
        yield int(b[lo]), order[lo:hi]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())])


def suspects(docs: DataFrame, length: int, buckets: int, hot: int, block: int) -> DataFrame:
    """doc_id, hash, hot: the anchors that stand at two places or more, where they stand."""

    def find(batches):
        roller = Roller(_STEP, 11)
        for table in held(batches, block):
            data, off = utf8(table["text"].combine_chunks())
            ids = np.asarray(table["doc_id"], np.int64)
            hs, ds = [], []
            for a, b in chunks(off, 1 << 18):
                h, _, _, d = anchors(data[off[a] : off[b]], off[a : b + 1], length, roller)
                hs.append(h)
                ds.append(ids[a:b][d])
            h, d = np.concatenate(hs), np.concatenate(ds)
            rows = [(k, h[i].tobytes(), d[i].tobytes()) for k, i in _by_bucket(h, buckets)]
            if rows:
                yield _rows(rows, _ANCHORS)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, U64) for x in frame["hashes"]])
        d = np.concatenate([np.frombuffer(x, np.int64) for x in frame["docs"]])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(new, len(h)))
        times = np.repeat(times, times)
        twice = times > 1
        h, d, times = h[twice], d[twice], times[twice]
        first = np.lexsort((d, h))
        h, d, times = h[first], d[first], times[first]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
        return pd.DataFrame({"doc_id": d[new], "hash": h[new].view(np.int64), "hot": times[new] > hot})

    packed = docs.mapInArrow(find, "bucket int, hashes binary, docs binary")
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(count, "doc_id long, hash long, hot boolean")


_SNIPPETS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("more", pa.binary())])
#: Kinds of packed rows: snippets, hot windows one by one, spans that a task has told already.
_COLD, _HOT, _TOLD = 0, 1, 2


def _runs(docs: np.ndarray, at: np.ndarray, length: int):
    """Windows (sorted by document and start) as spans (doc, start, end)."""
    if not len(at):
        return docs, at, at
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return docs[first], at[first], at[last] + length


def _take(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    if not len(start):
        return raw[:0]
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return raw[np.arange(int(size.sum())) + shift]


def snippets(docs: DataFrame, length: int, buckets: int, block: int) -> DataFrame:
    """Packed snippets of docs(doc_id, text, hashes, hots); hot windows that a task itself repeats come as spans."""

    def cut(batches):
        roller, second = Roller(_STEP, 11), Roller(_STEP2, 23)
        for table in held(batches, block):
            data, off = utf8(table["text"].combine_chunks())
            ids = np.asarray(table["doc_id"], np.int64)
            wanted, hots = table["hashes"].to_pylist(), table["hots"].to_pylist()
            parts: list[tuple] = []
            windows: list[tuple] = []
            for a, b in chunks(off, 1 << 18):
                raw, part = data[off[a] : off[b]], off[a : b + 1]
                h, start, n, d = anchors(raw, part, length, roller)
                keep, warm = np.zeros(len(h), bool), np.zeros(len(h), bool)
                cut = np.searchsorted(d, np.arange(b - a + 1))
                for i in range(b - a):
                    own = slice(cut[i], cut[i + 1])
                    keep[own] = np.isin(h[own], np.array(wanted[a + i], np.int64).view(U64))
                    if hots[a + i]:
                        warm[own] = np.isin(h[own], np.array(hots[a + i], np.int64).view(U64))
                base = (part - part[0])[:-1]
                i = np.flatnonzero(keep & ~warm)
                parts.append((h[i], ids[a:b][d[i]], start[i] - base[d[i]], n[i], _take(raw, start[i], n[i] + (length - 1))))
                i = np.flatnonzero(warm)
                if len(i):
                    at = np.repeat(start[i] - (np.cumsum(n[i]) - n[i]), n[i]) + np.arange(int(n[i].sum()))
                    owner = np.repeat(d[i], n[i])
                    windows.append((roller.at(roller.sums(raw), at, length), second.at(second.sums(raw), at, length), ids[a:b][owner], at - base[owner]))
            h, doc, start, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
            text = np.concatenate([p[4] for p in parts])
            size = n + (length - 1)
            begin = np.cumsum(size) - size
            rows = [
                (k, _COLD, h[i].tobytes(), doc[i].tobytes(), start[i].tobytes(), n[i].astype(np.int32).tobytes(), _take(text, begin[i], size[i]).tobytes())
                for k, i in _by_bucket(h, buckets)
            ]
            if windows:
                h, h2, doc, start = (np.concatenate([w[k] for w in windows]) for k in range(4))
                order = np.lexsort((start, doc, h2, h))
                h, h2, doc, start = h[order], h2[order], doc[order], start[order]
                first = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
                # what repeats a window of this very task is removed wherever the first one stands
                head = np.flatnonzero(first)
                again = ~first & ~((doc == np.repeat(doc[head], np.diff(np.append(head, len(h))))) & (start == np.repeat(start[head], np.diff(np.append(head, len(h))))))
                gone = np.lexsort((start[again], doc[again]))
                d1, s1, e1 = _runs(doc[again][gone], start[again][gone], length)
                if len(d1):
                    rows.append((int(d1[0] + s1[0]) % buckets, _TOLD, b"", d1.tobytes(), s1.tobytes(), e1.tobytes(), b""))
                h, h2, doc, start = h[first], h2[first], doc[first], start[first]
                rows += [(k, _HOT, h[i].tobytes(), doc[i].tobytes(), start[i].tobytes(), b"", h2[i].tobytes()) for k, i in _by_bucket(h, buckets)]
            if rows:
                yield _rows(rows, _SNIPPETS)

    return docs.mapInArrow(cut, "bucket int, kind int, keys binary, docs binary, starts binary, sizes binary, more binary")


def _hot_spans(rows: pd.DataFrame, length: int):
    h, h2 = (np.concatenate([np.frombuffer(x, U64) for x in rows[k]]) for k in ("keys", "more"))
    doc, start = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[k]]) for k in ("docs", "starts"))
    order = np.lexsort((start, doc, h2, h))
    h, h2, doc, start = h[order], h2[order], doc[order], start[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(h)))
    again = (doc != np.repeat(doc[head], size)) | (start != np.repeat(start[head], size))
    order = np.lexsort((start[again], doc[again]))
    return _runs(doc[again][order], start[again][order], length)


def _shard_spans(rows: pd.DataFrame, length: int):
    """Spans of the windows of a bucket's snippets that also start earlier, part by part."""
    h, doc, start, n = (np.concatenate([np.frombuffer(x, t) for x in rows[k]]) for k, t in (("keys", U64), ("docs", np.int64), ("starts", np.int64), ("sizes", np.int32)))
    text, n = b"".join(rows["more"]), n.astype(np.int64)
    end = np.cumsum(n + (length - 1))
    begin = end - n - (length - 1)
    for _, i in _by_bucket(mix64(h.copy()), max(1, len(text) // PART_BYTES)):
        yield _part_spans(h[i], doc[i], start[i], n[i], [text[a:b] for a, b in zip(begin[i].tolist(), end[i].tolist(), strict=True)], length)


def _part_spans(h: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, pieces: list[bytes], length: int):
    first: dict[bytes, int] = {}
    kind = np.fromiter((first.setdefault(x, len(first)) for x in pieces), np.int64, len(pieces))
    distinct = list(first)
    anchors_ = np.empty(len(distinct), U64)
    anchors_[kind] = h
    times = np.bincount(kind, minlength=len(distinct))
    # earliest occurrence of each distinct snippet
    order = np.lexsort((start, doc, kind))
    lead = order[np.concatenate([[True], kind[order][1:] != kind[order][:-1]])]
    lead_doc, lead_start = doc[lead], start[lead]
    by_anchor = np.argsort(anchors_, kind="stable")
    ranked = anchors_[by_anchor]
    cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    out_doc = [None] * len(distinct)
    out_start = [None] * len(distinct)
    shard: list[int] = []
    held = 0

    def close():
        nonlocal shard, held
        if not shard:
            return
        t = np.frombuffer(b"".join(distinct[k] + b"\0" for k in shard), np.uint8).astype(np.int64) + 2
        size = sizes[shard]
        ends = np.cumsum(size + 1) - 1
        t[ends] = 1
        t = np.append(t, 0)
        sa = suffix_array(t)
        lcp = common_prefixes(t, sa, length)
        group = np.empty(len(t), np.int64)
        group[sa] = np.cumsum(lcp < length)
        m = size - (length - 1)
        begin = ends - size
        which = np.repeat(np.arange(len(shard)), m)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
        g = group[begin[which] + inner]
        ids = np.array(shard)
        wd, ws = lead_doc[ids[which]], lead_start[ids[which]] + inner
        o = np.lexsort((ws, wd, g))
        new = np.concatenate([[True], g[o][1:] != g[o][:-1]])
        head = np.repeat(o[new], np.diff(np.append(np.flatnonzero(new), len(o))))
        fd, fs = np.empty(len(o), np.int64), np.empty(len(o), np.int64)
        fd[o], fs[o] = wd[head], ws[head]
        at = np.cumsum(m) - m
        for j, k in enumerate(shard):
            out_doc[k], out_start[k] = fd[at[j] : at[j] + m[j]], fs[at[j] : at[j] + m[j]]
        shard, held = [], 0

    for lo, hi in zip(cut, np.append(cut[1:], len(ranked)), strict=True):
        own = by_anchor[lo:hi]
        if times[own].sum() < 2:  # its other place was a window of a hot anchor, or a hash of another gram
            continue
        shard += own.tolist()
        held += int(sizes[own].sum())
        if held >= SHARD_BYTES:
            close()
    close()
    sorted_ = np.array([x is not None for x in out_doc], bool)
    use = np.flatnonzero(sorted_[kind])
    if not len(use):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    m = n[use]
    inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    d, s = np.repeat(doc[use], m), np.repeat(start[use], m) + inner
    fd, fs = np.concatenate([out_doc[k] for k in kind[use]]), np.concatenate([out_start[k] for k in kind[use]])
    again = (d != fd) | (s != fs)
    d, s = d[again], s[again]
    order = np.lexsort((s, d))
    return _runs(d[order], s[order], length)


def repeated_spans(packed: DataFrame, length: int, buckets: int) -> DataFrame:
    """doc_id, start, end: spans of removed bytes, which may touch or overlap."""

    def find(key, frame: pd.DataFrame) -> pd.DataFrame:
        of = {k: frame[frame["kind"] == k] for k in (_COLD, _HOT, _TOLD)}
        out = [tuple(np.frombuffer(x, np.int64) for x in t) for t in zip(of[_TOLD]["docs"], of[_TOLD]["starts"], of[_TOLD]["sizes"], strict=True)]
        if len(of[_HOT]):
            out.append(_hot_spans(of[_HOT], length))
        if len(of[_COLD]):
            out += _shard_spans(of[_COLD], length)
        return pd.DataFrame({k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("doc_id", "start", "end"))})

    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(find, "doc_id long, start long, end long")


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = 4000, block: int = 3 << 20, bucket: int = 10 << 20, as_text: bool = False) -> DataFrame:
    """doc_id, n_removed, n_spans, kept of the documents that lose bytes; the others aren't listed.

    kept holds the remaining bytes, or with `as_text` the text they spell, without characters that lost a part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(f"doc_id is not null and octet_length(text) >= {length}")
    buckets = max(1, -(-(slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // bucket))
    found = suspects(slim, length, buckets, hot, block)
    lists = found.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"), F.collect_list(F.when(F.col("hot"), F.col("hash"))).alias("hots"))
    spans = repeated_spans(snippets(slim.join(materialize(lists, "anchors"), "doc_id"), length, buckets, block), length, buckets)
    gone = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def strike(batches):
        for batch in batches:
            ids, rows, texts_ = [], [], columns(batch, "text")[0].to_pylist()
            for i, t, sp in zip(columns(batch, "doc_id")[0].to_pylist(), texts_, columns(batch, "spans")[0].to_pylist(), strict=True):
                raw, upto, kept, n, runs = t.encode(), 0, [], 0, 0
                for x in sorted((x["start"], x["end"]) for x in sp):
                    a, b = x
                    if a > upto or not runs:
                        kept.append(raw[upto:a])
                        runs += 1
                        n += b - a
                    elif b > upto:
                        n += b - upto
                    upto = max(upto, b)
                kept.append(raw[upto:])
                ids.append(i)
                rows.append((n, runs, b"".join(kept).decode(errors="ignore") if as_text else b"".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string() if as_text else pa.binary())], ["doc_id", "n_removed", "n_spans", "kept"])

    struck = slim.join(gone, "doc_id").mapInArrow(strike, f"doc_id long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return struck.dropDuplicates(["doc_id"])


def struck_documents(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    struck = remove_repeats(docs, length).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("rest"))
    zero = F.lit(0).cast("long")
    return base.join(struck, "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("rest", "whole").alias("kept_sha256"))
