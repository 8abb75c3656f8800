"""N-gram language model in sharded Elias-Fano tries, and the scores of whole texts under it.

Tokens are lower-cased (A-Z) words, then one end per text; contexts are the `order` - 1 words
before, as far as the beginning of the text, which counts as one. From single words, P(w) =
(c(w) + 1) / (N + V + 1), each longer context h refines the one without its first word, h':
P(w | h) = max(c(h w) - d, 0) / c(h) + d * kinds(h) / c(h) * P(w | h'). No entry is pruned.

Data moves in packed pieces, never as a row per token:

1. Tasks cut texts into blocks, number each block's words and leave the block's tokens as a file
   in the shared folder.
2. Words of all blocks meet in buckets by hash: counts c, dense word ids, N and V. Each block gets
   its own words' counts and ids back. A word is one entry per block, so none is hot.
3. A block's distinct pairs go to the shard of their first word, and its triples below them, each
   an entry per block. The shard sums them, builds its trie, maps it and answers for the entries
   it was sent. A word with over a thousandth of all tokens is split by its successors, and a pair
   of two such words by its successors; their numbers of successors are added up for all blocks (a
   thousand words and a million pairs at most, whatever the corpus).
4. Each block is scored from its file and its answers; it works its entries out again, which takes
   less room than a file of them.

Buckets and shards are as many as the text has pieces of `shard` bytes, so a group's size doesn't
grow with the corpus; a block sends a shard one row, or none. What a step leaves is deleted once
the next is written.

A shard's trie is one file that its task maps into memory: word ids, pointers to their pairs and
from these to their triples (monotone Elias-Fano sequences with a sampled select directory), the
entries' words, made monotone by adding context rank times vocabulary (so a search is relative to
its context), and an 8-bit code per entry for its discounted count, the numerator of the smoothed
probability: exact to 64, steps of a twentieth decade beyond. The codes are the same in every
shard, so scores don't depend on how rows fall into blocks and shards.

Defined cases: null and empty texts are one end token; repeated rows score alike; a null doc_id
counts as held in (it has no crc); a corpus without training rows has N = V = 0 and every token
is unknown; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, WordHasher, chunks, discard, held, materialize, mix64, scratch, small_batches, utf8

END = U64(1)


# --- files ------------------------------------------------------------------------------------
def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def save(uri: str, arrays: dict[str, np.ndarray], compress: bool = True) -> None:
    """Arrays in one file: an Arrow record batch of binaries, split into byte planes and compressed if asked."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    names, values = [], []
    for k, v in arrays.items():
        raw = v.view(np.uint8).reshape(len(v), -1).T.tobytes() if compress and len(v) else v.tobytes()
        names.append(f"{k}:{v.dtype.str}:{len(v)}")
        values.append(pa.array([z.compress(raw) if compress else raw], pa.large_binary()))
    batch = pa.RecordBatch.from_arrays(values, names)
    fs, path = _fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write(batch)


def load(uri: str, compress: bool = True) -> dict[str, np.ndarray]:
    """What save() left; uncompressed arrays of a local file stay mapped, not read."""
    import zstandard
    from pyarrow import fs as pfs

    fs, path = _fs(uri)
    source = pa.memory_map(path) if isinstance(fs, pfs.LocalFileSystem) else fs.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(0)
    out, z = {}, zstandard.ZstdDecompressor()
    for k, column in zip(batch.schema.names, batch.columns, strict=True):
        name, kind, n = k.rsplit(":", 2)
        raw, dtype, n = column[0].as_buffer(), np.dtype(kind), int(n)
        if compress:
            raw = z.decompress(raw)
            planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n) if n else np.zeros((dtype.itemsize, 0), np.uint8)
            out[name] = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
        else:
            out[name] = np.frombuffer(raw, dtype)
    return out


# --- Elias-Fano -------------------------------------------------------------------------------
#: Place of the k-th one of each byte.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence: low bits packed; high bits as unary gaps in 64-bit words, with the number of ones
    before each word as a directory. All arrays are used where they are, mapped or not."""

    def __init__(self, meta: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.top = (int(x) for x in meta)
        self.low, self.high, self.ones = low, high, ones
        self.zeros = np.arange(len(ones), dtype=ones.dtype) * ones.dtype.type(64) - ones

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        bits = min(57, max(0, int(universe // max(1, n)).bit_length() - 1))
        v = values.astype(np.uint64)
        upper = (v >> U64(bits)).astype(np.int64)
        top = int(upper[-1]) if n else 0
        gaps = np.zeros(-(-(top + n + 1) // 64) * 64, np.uint8)
        gaps[upper + np.arange(n)] = 1
        high = np.packbits(gaps, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.uint32 if len(gaps) < 1 << 32 else np.uint64)
        lows = [np.zeros(0, np.uint8)]
        if bits and n:
            shifts = np.arange(bits, dtype=np.uint64)[::-1]
            lows = [np.packbits(((v[a : a + 65536, None] >> shifts) & U64(1)).astype(np.uint8).ravel()) for a in range(0, n, 65536)]
        return {"meta": np.array([n, bits, top], np.int64), "low": np.concatenate([*lows, np.zeros(8, np.uint8)]), "high": high, "ones": np.cumsum(ones, dtype=ones.dtype) - ones}

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits  # the bits lie within the eight bytes from the first one's
        word = np.lib.stride_tricks.sliding_window_view(self.low, 8)[at >> 3].view(">u8").ravel().astype(U64)
        return ((word << (at & 7).astype(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def _select(self, i: np.ndarray, zero: bool) -> np.ndarray:
        """Position of the i-th one, or zero, of the high bits."""
        before, out = self.zeros if zero else self.ones, np.empty(len(i), np.int64)
        for a in range(0, len(i), 1 << 15):
            left = i[a : a + (1 << 15)].astype(before.dtype)
            at = np.searchsorted(before, left, side="right") - 1
            left -= before[at]
            word, place, left = ~self.high[at] if zero else self.high[at], at << 6, left.astype(np.uint8)
            for half in (32, 16, 8):
                low = word & U64((1 << half) - 1)
                n = np.bitwise_count(low)
                up = left >= n
                left = np.where(up, left - n, left)
                word = np.where(up, word >> U64(half), low)
                place += up * half
            out[a : a + (1 << 15)] = place + _PLACE[word.astype(np.int64), left]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, False) - i) << self.bits) | self._lows(i)

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, value) of the first element >= each target; index n, value -1 where there is none."""
        at, value = np.full(len(targets), self.n, np.int64), np.full(len(targets), -1, np.int64)
        upper = targets >> self.bits
        some = np.flatnonzero(upper <= self.top) if self.n else np.zeros(0, np.int64)
        upper, want = upper[some], targets[some] & ((1 << self.bits) - 1)
        # elements with that upper part stand between the zeros before and after it
        lo = np.zeros(len(some), np.int64)
        lo[upper > 0] = self._select(upper[upper > 0] - 1, True) - (upper[upper > 0] - 1)
        end = self._select(upper, True) - upper
        while True:
            live = np.flatnonzero(lo < end)
            if not len(live):
                break
            mid = (lo[live] + end[live]) >> 1
            below = self._lows(mid) < want[live]
            lo[live[below]] = mid[below] + 1
            end[live[~below]] = mid[~below]
        at[some] = lo
        inside = at < self.n
        value[inside] = self.get(at[inside])
        return at, value


_EXACT, _STEPS = 64, 20
#: Counts that codes stand for.
COUNTS = np.concatenate([np.arange(_EXACT + 1), _EXACT * 10 ** (np.arange(1, 256 - _EXACT) / _STEPS)])


def quantise(counts: np.ndarray) -> np.ndarray:
    """8-bit codes of counts."""
    steps = np.rint(_STEPS * np.log10(np.maximum(counts, 1) / _EXACT)).astype(np.int64)
    return np.where(counts <= _EXACT, counts, np.clip(_EXACT + steps, _EXACT, 255)).astype(np.uint8)


class Trie:
    """One shard: words, their pairs, their triples, as written by build() and mapped by open()."""

    @staticmethod
    def build(uri: str, words: np.ndarray, pairs: tuple, triples: tuple, vocabulary: int) -> None:
        """pairs and triples: (rank of the context in the level above, word, count), sorted."""
        arrays, n = {"words": words}, len(words)
        universe = {"words": int(words[-1]) + 1 if n else 1}
        for name, (rank, word, count) in (("pairs", pairs), ("triples", triples)):
            arrays[name] = rank * (vocabulary + 1) + word
            arrays[f"{name}_from"] = np.searchsorted(rank, np.arange(n + 1))
            universe |= {name: (n + 1) * (vocabulary + 1), f"{name}_from": len(rank) + 1}
            arrays[f"{name}_codes"], n = quantise(count), len(rank)
        out = {"vocabulary": np.array([vocabulary], np.int64)}
        for name, values in arrays.items():
            out |= {f"{name}-{k}": v for k, v in EliasFano.encode(values, universe[name]).items()} if name in universe else {name: values}
        save(uri, out, compress=False)

    @classmethod
    def open(cls, uri: str) -> Trie:
        a, t = load(uri, compress=False), cls()
        for name in ("words", "pairs", "pairs_from", "triples", "triples_from"):
            setattr(t, name, EliasFano(*(a[f"{name}-{k}"] for k in ("meta", "low", "high", "ones"))))
        t.pairs_codes, t.triples_codes, t.vocabulary = a["pairs_codes"], a["triples_codes"], int(a["vocabulary"][0])
        return t

    def find_words(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word, or -1."""
        at, value = self.words.successor(words)
        return np.where(value == words, at, -1)

    def find(self, level: str, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The entry's rank, or -1, for each word below each context's rank."""
        target = context * (self.vocabulary + 1) + words
        out, known = np.full(len(words), -1, np.int64), np.flatnonzero(context >= 0)
        at, value = getattr(self, level).successor(target[known])
        out[known] = np.where(value == target[known], at, -1)
        return out

    def kinds(self, level: str, rank: np.ndarray) -> np.ndarray:
        """How many entries stand below each context's rank; 0 below -1."""
        at, known = getattr(self, f"{level}_from"), rank >= 0
        out = np.zeros(len(rank), np.int64)
        out[known] = at.get(rank[known] + 1) - at.get(rank[known])
        return out


# --- the passes -------------------------------------------------------------------------------
def _pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    import zstandard

    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=3).compress(v.view(np.uint8).reshape(len(v), -1).T.tobytes()) if len(v) else b""


def _unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    kind = np.dtype(kind)
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray):
    """(key, from, to) of each run."""
    if len(sorted_keys):
        new = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        yield from zip(sorted_keys[new].tolist(), new.tolist(), [*new[1:].tolist(), len(sorted_keys)], strict=True)


def _blocks(docs: DataFrame, folder: str, size: int) -> DataFrame:
    """Writes the blocks' files; a row (block, n_bytes, n_train, words, counts) for each, words packed in hash order."""

    def write(batches):
        def flush(table):
            data, off = utf8(table["text"].combine_chunks())
            hasher, parts, lengths = WordHasher(SPACE_WORDS), [], []
            for a, b in chunks(off):
                h, _, _, first = hasher(data, off[a : b + 1])
                size_ = np.diff(first)
                out = np.full(len(h) + len(size_), END)
                out[np.arange(len(h)) + np.repeat(np.arange(len(size_)), size_)] = h
                parts.append(out)
                lengths.append(size_ + 1)
            tokens, lengths = np.concatenate(parts), np.concatenate(lengths)
            words, local = np.unique(tokens, return_inverse=True)
            train = np.asarray(table["train"])
            counts = np.bincount(local[np.repeat(train, lengths)], minlength=len(words)).astype(np.uint32)
            ids = table["doc_id"].combine_chunks()
            uri = f"{folder}/block-{uuid.uuid4().hex}"
            save(uri, {"doc_ids": np.asarray(ids.fill_null(0), np.int64), "nulls": np.asarray(ids.is_null()).astype(np.uint8), "train": train.astype(np.uint8), "lengths": lengths.astype(np.int32), "tokens": local.astype(np.int32)})
            row = (uri, int(off[-1] - off[0]), int(train.sum()), _pack(np.diff(words, prepend=U64(0))), _pack(counts))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "n_bytes", "n_train", "words", "counts"])

        for table in held(batches, size):
            yield flush(table)

    return docs.mapInArrow(write, "block string, n_bytes long, n_train long, words binary, counts binary")


def _dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row per block and bucket of its words."""

    def deal(frames):
        for f in frames:
            rows = []
            for block, words, counts in zip(f["block"], f["words"], f["counts"], strict=True):
                words, counts = np.cumsum(_unpack(words, U64), dtype=U64), _unpack(counts, np.uint32)
                rows += [(block, k, _pack(np.diff(words[a:b], prepend=U64(0))), _pack(counts[a:b])) for k, a, b in _cuts(_bucket(words, buckets))]
            yield pd.DataFrame(rows, columns=["block", "bucket", "words", "counts"])

    return blocks.select("block", "words", "counts").mapInPandas(deal, "block string, bucket int, words binary, counts binary")


def _count_words(frame: pd.DataFrame) -> pd.DataFrame:
    """For each block's words of a bucket: training counts, and ranks among the words that have one."""
    words = [np.cumsum(_unpack(x, U64), dtype=U64) for x in frame["words"]]
    counts = [_unpack(x, np.uint32) for x in frame["counts"]]
    distinct, where = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    rank = (np.cumsum(total > 0) - 1).astype(np.int64)
    cut = np.cumsum([len(w) for w in words])[:-1]
    c, r = np.split(total[where], cut), np.split(rank[where], cut)
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "counts": [_pack(x) for x in c], "ranks": [_pack(np.diff(x, prepend=0)) for x in r], "n_words": int((total > 0).sum()), "n_tokens": int(total.sum())})


class Entries:
    """The distinct pairs and triples of a block, in the order of their shards, and each token's place among them.

    word: tokens as ranks of the block's words, -1 of which (`begin`) stands for the beginning; ids and counts: of
    these words, ids ascending among those with a count.
    """

    def __init__(self, word, lengths, ids, counts, n, shards, splits, order):
        begin, wide = len(ids) - 1, len(ids)
        first = np.zeros(len(word), bool)
        first[np.cumsum(lengths) - lengths] = True
        self.before = np.concatenate([[begin], word[:-1]])
        self.before[first] = begin
        known, self.frequent = counts > 0, counts * 1000 > n
        known[begin] = self.frequent[begin] = True
        h = mix64(ids.astype(U64) + U64(1))
        piece = (ids % splits).astype(U64)
        # pairs
        ok = known[word] & known[self.before]
        self.pair_of = np.full(len(word), -1)
        pair, self.pair_of[ok] = np.unique(self.before[ok] * wide + word[ok], return_inverse=True)
        self.a, self.b = np.divmod(pair, wide)
        shard = _bucket(np.where(self.frequent[self.a], mix64(h[self.a] + piece[self.b]), h[self.a]), shards)
        self.double = self.frequent[self.a] & self.frequent[self.b]
        # triples below the pair before
        self.triple_of = np.full(len(word), -1)
        later = np.flatnonzero(~first[1:] & (self.pair_of[:-1] >= 0) & known[word[1:]]) + 1 if order > 2 else np.zeros(0, np.int64)
        triple, where = np.unique(self.pair_of[later - 1] * wide + word[later], return_inverse=True)
        up, c = np.divmod(triple, wide)
        split = np.flatnonzero(self.double[up]) if len(up) else up
        apart = _bucket(mix64(mix64(h[self.a[up[split]]] + h[self.b[up[split]]] * U64(3)) + piece[c[split]]), shards)
        # where a pair stands: in its own shard, and in those of the pieces of its triples
        n_pairs = max(1, len(pair))
        places, at = np.unique(np.concatenate([shard * n_pairs + np.arange(len(pair)), apart * n_pairs + up[split]]), return_inverse=True)
        self.home, above = at[: len(pair)], at[up] if len(up) else up
        above[split] = at[len(pair) :]
        self.shard, self.pair = np.divmod(places, n_pairs)
        by = np.argsort(above, kind="stable")
        self.triple_of[later] = np.argsort(by)[where] if len(by) else where
        self.c, self.above = c[by], above[by]
        # contexts of the pairs, run by run, and those that have none
        self.run = np.flatnonzero(np.concatenate([[True], (self.shard[1:] != self.shard[:-1]) | (self.a[self.pair[1:]] != self.a[self.pair[:-1]])])) if len(places) else np.zeros(0, np.int64)
        alone = np.setdiff1d(np.flatnonzero((np.bincount(self.before, minlength=wide) > 0) & known & ~self.frequent), self.a)
        context = np.concatenate([self.a[self.pair[self.run]], alone])
        c_shard = np.concatenate([self.shard[self.run], _bucket(h[alone], shards)])
        size = np.concatenate([np.diff(np.append(self.run, len(places))), np.zeros(len(alone), np.int64)])
        by = np.lexsort((context, c_shard))
        self.context, self.c_shard, self.size = context[by], c_shard[by], size[by]

    def times(self, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often training tokens have each place's pair (in its own shard) and each triple."""
        pairs, triples = np.zeros(len(self.pair), np.int64), np.bincount(self.triple_of[learns & (self.triple_of >= 0)], minlength=len(self.c))
        pairs[self.home] = np.bincount(self.pair_of[learns & (self.pair_of >= 0)], minlength=len(self.home))
        return pairs, triples


_ASKED = ["contexts", "sizes", "frequent", "words", "times", "double", "kids", "thirds", "third_times"]


def _answer(frame: pd.DataFrame, uri: str, kind, v: int) -> pd.DataFrame:
    """Builds a shard's trie and looks up what each block asked; successors of split contexts come as a row of their own."""
    kinds = dict(zip(_ASKED, (np.int64, np.uint32, bool, kind, np.uint32, bool, np.uint32, kind, np.uint32), strict=True))
    got = [{k: _unpack(row[k], t) for k, t in kinds.items()} for row in frame[_ASKED].to_dict("records")]
    for g in got:
        g["contexts"] = np.cumsum(g["contexts"])
        g["first"] = np.repeat(g["contexts"], g["sizes"])
        g["words"], g["thirds"] = g["words"].astype(np.int64), g["thirds"].astype(np.int64)
    all_of = lambda k: np.concatenate([g[k] for g in got])
    # pairs of all blocks, those that only carry triples among them
    key = all_of("first") * (v + 2) + all_of("words")
    pair, where = np.unique(key, return_inverse=True)
    count = np.bincount(where, all_of("times"), minlength=len(pair)).astype(np.int64)
    word, rank = np.unique(pair // (v + 2), return_inverse=True)
    below = np.repeat(where, all_of("kids")) * (v + 2) + all_of("thirds")
    triple, at = np.unique(below, return_inverse=True)
    third = np.bincount(at, all_of("third_times"), minlength=len(triple)).astype(np.int64)
    del key, below
    up = triple // (v + 2)
    # what training never had is asked only; a pair without a count stays where triples stand below it
    real, has = third > 0, count > 0
    has[up[real]] = True
    place = np.cumsum(has) - 1
    heads, of = np.unique(rank[has], return_inverse=True)
    Trie.build(uri, word[heads], (of, pair[has] % (v + 2), count[has]), (place[up[real]], triple[real] % (v + 2), third[real]), v)
    trie = Trie.open(uri)
    # each distinct entry is looked up once, whatever the number of blocks that ask for it
    words = np.unique(all_of("contexts"))
    w = trie.find_words(words)
    i = trie.find("pairs", w[np.searchsorted(words, word)][rank], pair % (v + 2))
    j = trie.find("triples", i[up], triple % (v + 2))
    counted = np.concatenate([[0], np.cumsum(trie.pairs_codes > 0)])
    n2 = np.zeros(len(words), np.int64)
    n2[w >= 0] = counted[trie.pairs_from.get(w[w >= 0] + 1)] - counted[trie.pairs_from.get(w[w >= 0])]
    n3 = trie.kinds("triples", i)

    def code(codes: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.where(i >= 0, codes[np.maximum(i, 0)], 0).astype(np.uint8) if len(codes) else np.zeros(len(i), np.uint8)

    code2, code3 = code(trie.pairs_codes, i), code(trie.triples_codes, j)
    out, split, p, t = [], {}, 0, 0
    for block, g in zip(frame["block"], got, strict=True):
        mine, below = where[p : p + len(g["words"])], at[t : t + len(g["thirds"])]
        p, t = p + len(mine), t + len(below)
        own = np.searchsorted(words, g["contexts"])
        out.append((block, int(frame["shard"].iloc[0]), _pack(code2[mine]), _pack(n2[own].astype(np.uint32)), _pack(code3[below]), _pack(n3[mine].astype(np.uint32)), [], [], []))
        f = np.flatnonzero(g["frequent"])
        split |= zip(zip(g["contexts"][f].tolist(), [-1] * len(f), strict=True), n2[own[f]].tolist(), strict=True)
        f = np.flatnonzero(g["double"])
        split |= zip(zip(g["first"][f].tolist(), g["words"][f].tolist(), strict=True), n3[mine[f]].tolist(), strict=True)
    out.append(("", int(frame["shard"].iloc[0]), b"", b"", b"", b"", [k[0] for k in split], [k[1] for k in split], list(split.values())))
    return pd.DataFrame(out, columns=["block", "shard", "codes2", "kinds2", "codes3", "kinds3", "a", "b", "kinds"])


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, discount: float = 0.75, block: int = 6 << 20, shard: int = 12 << 20, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs. order: 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "language-model")
    doc_id = F.col("doc_id").cast("long")
    train = F.coalesce(F.crc32(doc_id.cast("string")) % modulus != held, F.lit(True))
    slim = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train"))
    blocks = materialize(_blocks(slim, folder, block), "words")
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("n_bytes").alias("bytes"), F.sum("n_train").alias("train")).first()
    n_blocks, n_train, shards = max(1, size["blocks"]), size["train"] or 0, max(1, -(-(size["bytes"] or 0) // shard))
    splits = max(16, shards // 16)
    by = lambda df, key, n: df.repartition(n, key).groupBy(key)
    counted = materialize(by(_dealt(blocks, shards), "bucket", shards).applyInPandas(_count_words, "block string, bucket int, counts binary, ranks binary, n_words long, n_tokens long"), "counts")
    discard(blocks)
    # one row per bucket: where its word ids start
    sizes = {r["bucket"]: (r["n_words"], r["n_tokens"]) for r in counted.groupBy("bucket").agg(F.max("n_words").alias("n_words"), F.max("n_tokens").alias("n_tokens")).collect()}
    starts = np.cumsum([0] + [sizes.get(k, (0, 0))[0] for k in range(shards)])
    v, n = int(starts[-1]), sum(x for _, x in sizes.values())
    if (v + 2) ** 2 >= 1 << 63:
        raise ValueError("two word ids don't fit 63 bits")
    kind = np.uint32 if v < (1 << 32) - 1 else np.int64

    def known(key) -> tuple:
        """A block's tokens and, with the beginning last, its words' ids and counts."""
        b, own = load(key), load(f"{key}-ids")
        lengths, word = b["lengths"].astype(np.int64), b["tokens"].astype(np.int64)
        return b, lengths, word, Entries(word, lengths, own["ids"], own["counts"], n, shards, splits, order), own["ids"], own["counts"]

    def tell(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bucket")
        counts = np.concatenate([*(_unpack(x, np.int64) for x in frame["counts"]), [n_train]])
        ids = np.concatenate([*(np.cumsum(_unpack(x, np.int64)) + starts[k] for k, x in zip(frame["bucket"], frame["ranks"], strict=True)), [v]])
        save(f"{key[0]}-ids", {"ids": ids, "counts": counts})
        b, lengths, _, e, _, _ = known(key[0])
        pairs, triples = e.times(np.repeat(b["train"].astype(bool), lengths))
        kids, rows, at, last = np.bincount(e.above, minlength=len(e.pair)), [], 0, 0
        for k, lo, hi in _cuts(e.c_shard):
            end = at + int(e.size[lo:hi].sum())
            stop = last + int(kids[at:end].sum())
            p = e.pair[at:end]
            rows.append((key[0], k, *map(_pack, (
                np.diff(ids[e.context[lo:hi]], prepend=0), e.size[lo:hi].astype(np.uint32), e.frequent[e.context[lo:hi]], ids[e.b[p]].astype(kind), pairs[at:end].astype(np.uint32), e.double[p],
                kids[at:end].astype(np.uint32), ids[e.c[last:stop]].astype(kind), triples[last:stop].astype(np.uint32),
            ))))
            at, last = end, stop
        # a block of unknown words has nothing to ask, but has to be scored
        return pd.DataFrame(rows or [(key[0], 0, *[b""] * len(_ASKED))], columns=["block", "shard", *_ASKED])

    def answer(key, frame: pd.DataFrame) -> pd.DataFrame:
        uri = f"{folder}/trie-{key[0]:06d}-{uuid.uuid4().hex[:8]}"
        out = _answer(frame, uri, kind, v)
        fs, path = _fs(uri)
        fs.delete_file(path)
        return out

    told = by(counted.drop("n_words", "n_tokens"), "block", n_blocks).applyInPandas(tell, "block string, shard int, " + ", ".join(f"{k} binary" for k in _ASKED))
    answered = "block string, shard int, codes2 binary, kinds2 binary, codes3 binary, kinds3 binary, a array<long>, b array<long>, kinds array<long>"
    answers = materialize(by(told, "shard", shards).applyInPandas(answer, answered), "answers")
    # successors of split contexts: a thousand words and a million pairs at most
    split = answers.filter("block = ''").select(F.inline(F.arrays_zip("a", "b", "kinds"))).groupBy("a", "b").agg(F.sum("kinds").alias("kinds")).toPandas().sort_values(["a", "b"])
    split_key, split_kinds = split["a"].to_numpy(np.int64) * (v + 2) + split["b"].to_numpy(np.int64) + 1, split["kinds"].to_numpy(np.int64)

    def whole(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Successors of contexts of which the shards have parts; own, if there are none."""
        if not len(split_key):
            return own
        key = a * (v + 2) + b + 1
        r = np.minimum(np.searchsorted(split_key, key), len(split_key) - 1)
        return np.where(split_key[r] == key, split_kinds[r], own)

    def refined(count: np.ndarray, kinds: np.ndarray, total: np.ndarray, p: np.ndarray) -> np.ndarray:
        """P(w | h) from P(w | h'). All entries of a context have total - d * kinds together, so a rounded count has no more."""
        rest = discount * kinds
        return (np.clip(count - discount, 0, np.maximum(total - rest, 0)) + rest * p) / total

    def score(key, frame: pd.DataFrame) -> pd.DataFrame:
        b, lengths, word, e, ids, counts = known(key[0])
        frame = frame.sort_values("shard")
        heard = lambda k, t: np.concatenate([_unpack(x, t) for x in frame[k]])
        single = (counts[word] + 1) / (n + v + 1)
        kinds = np.zeros(len(ids), np.int64)
        kinds[e.context] = heard("kinds2", np.uint32)
        split_words = np.flatnonzero(e.frequent)
        kinds[split_words] = whole(ids[split_words], np.full(len(split_words), -1), np.zeros(len(split_words), np.int64))
        pairs = np.append(COUNTS[heard("codes2", np.uint8)[e.home]], 0)  # the last is for no pair
        total = np.maximum(counts, 1)[e.before]
        p = single
        p = np.where(counts[e.before] > 0, refined(pairs[e.pair_of], kinds[e.before], total, p), p)
        if order > 2 and len(e.home):
            kinds3 = heard("kinds3", np.uint32).astype(np.int64)[e.home]
            kinds3 = np.append(np.where(e.double, whole(ids[e.a], ids[e.b], kinds3), kinds3), 0)
            triples = np.append(COUNTS[heard("codes3", np.uint8)], 0)
            up = np.concatenate([[-1], e.pair_of[:-1]])
            up[e.before == len(ids) - 1] = -1
            p = np.where(pairs[up] > 0, refined(triples[e.triple_of], kinds3[up], np.maximum(pairs[up], 1), p), p)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda x: np.bincount(owner, x, minlength=len(lengths))
        doc_ids = pd.array(b["doc_ids"], dtype="Int64")
        doc_ids[b["nulls"].astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": doc_ids, "held_out": ~b["train"].astype(bool), "n_tokens": lengths, "n_known": add(counts[word] > 0).astype(np.int64), "train_tokens": n, "base_score": add(np.log10(single)), "score": add(np.log10(p))})

    asked = answers.filter("block <> ''").drop("a", "b", "kinds")
    return by(asked, "block", n_blocks).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
