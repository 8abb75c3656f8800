"""SentencePiece segmentations sampled from the piece lattice, and lossless decoding.

A text is cut between neighbours that no piece joins (before a space, at signs, at characters
without a piece), so each part has a lattice of its own. Forward filtering sums, per position of a
part, the weights of all ways to reach it; backward sampling draws a way from the end to the start in proportion. Parts are
filtered once per task while they last in a bounded cache; sampling runs over all parts of a
block of texts at once, one step back per pass. Draws depend on the row key, the part's place in
the text and the step only, so a text is segmented alike wherever and whenever it is read.

A BPE model has merge ranks, not probabilities; piece weights are (rank + `shift`) ** -`theta`.
Characters without a piece, and U+2581 itself, which stands for a space in pieces, are spelled in
byte pieces; decoding joins pieces and bytes and drops the leading space that the model adds.

Defined cases: a null or empty text has no pieces; a null key seeds like 0; repeated rows are
segmented alike; other columns are ignored by `encode` and kept by the caller's join.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, columns, mix64

_PART = re.compile(r" +[^ ]*|[^ ]+")


_A, _A_INV = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which hashes of all substrings follow, and the inverse powers."""
    step = np.full(len(points) + 1, _A)
    step[0] = U64(1)
    powers = np.cumprod(step, dtype=U64)
    step[1:] = _A_INV
    out = np.zeros(len(points) + 1, U64)
    np.cumsum(mix64(points.astype(U64) + U64(1)) * powers[:-1], out=out[1:])
    return out, np.cumprod(step, dtype=U64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Pieces:
    """A model's pieces (with plain spaces): by length, their hashes and those of longer ones' beginnings."""

    def __init__(self, path: str, theta: float, shift: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.weight: dict[str, float] = {}
        self.raw: list[bytes] = []
        self.byte = [-1] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.raw.append(text.encode())
                if " " in text.lstrip(" "):
                    continue  # would span two parts
                self.ids[text] = i
                self.weight[text] = (max(0.0, -sp.get_score(i)) + shift) ** -theta
        if min(self.byte) < 0:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.ids))
        begun = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.tables = []
        for n in range(1, self.longest + 1):
            own = [x for x in begun if len(x) == n]
            hashes = np.array([int(_sums(_points(x))[0][-1]) for x in own], U64)
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array([self.ids.get(own[k], -1) for k in order], np.int64), np.log([self.weight.get(own[k], 1.0) for k in order])))
        self.single = np.array(sorted(ord(x) for x in self.ids if len(x) == 1), np.uint32)
        inner = {x[k : k + 2] for x in self.ids for k in range(len(x) - 1)}
        self.pairs = np.array(sorted((ord(x[0]) << 21) | ord(x[1]) for x in inner), np.int64)


@lru_cache(maxsize=2)
def pieces(path: str, theta: float, shift: float) -> Pieces:
    return Pieces(path, theta, shift)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def lattices(points: np.ndarray, first: np.ndarray, p: Pieces):
    """Forward filtering of many parts at once (part k is points[first[k]:first[k + 1]], of characters with pieces).

    Node i + k is the place before point i of part k, node first[k + 1] + k its end. Returns edges
    sorted by end: (end, start, piece, share of what reaches the end by it).
    """
    n_parts, size = len(first) - 1, np.diff(first)
    sums, inverse = _sums(points)
    owner = np.repeat(np.arange(n_parts), size)
    stop = first[1:][owner]
    live, found = np.arange(len(points)), []
    for n, (hashes, ids, logs) in enumerate(p.tables, 1):
        live = live[live + n <= stop[live]]
        if not len(live):
            break
        h = (sums[live + n] - sums[live]) * inverse[live]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        live, at = live[hit], at[hit]
        whole = ids[at] >= 0
        found.append((live[whole], np.full(int(whole.sum()), n), ids[at[whole]], logs[at[whole]]))
    start, length, piece, log = (np.concatenate([f[k] for f in found]) for k in range(4))
    start_node = start + owner[start]
    end_node, step = start_node + length, start + length - first[:-1][owner[start]]
    order = np.lexsort((end_node, step))
    start_node, end_node, piece, log, step = start_node[order], end_node[order], piece[order], log[order], step[order]
    alpha = np.zeros(len(points) + n_parts)
    reached = np.empty(len(order))
    cut = np.append(np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])), len(step))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        v = alpha[start_node[lo:hi]] + log[lo:hi]
        e = end_node[lo:hi]
        head = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        times = np.diff(np.append(head, hi - lo))
        top = np.maximum.reduceat(v, head)
        total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, times)), head))
        alpha[e[head]] = total
        reached[lo:hi] = np.exp(v - np.repeat(total, times))
    order = np.argsort(end_node, kind="stable")
    return end_node[order], start_node[order], piece[order], reached[order]


class Sampler:
    """Samples segmentations of many texts at once; its caches start anew beyond `most` nodes."""

    def __init__(self, path: str, theta: float, shift: float, most: int = 3_000_000):
        self.pieces, self.most = pieces(path, theta, shift), most
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: dict[int, int] = {}
        self.word_first, self.word_size, self.word_parts = (np.zeros(0, np.int64) for _ in range(3))
        self.base, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.arrive = np.zeros(0, np.int64)
        self.upto, self.start, self.piece = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.nodes = 0

    def _learn(self, words: list[str]) -> None:
        """Cuts new words where no piece spans two characters, and filters the parts that are new."""
        p = self.pieces
        points = _points("".join(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        word_first = np.cumsum(size) - size
        plain = _member(points, p.single) & (points != 0x2581)
        cut = np.ones(len(points), bool)
        cut[1:] = ~(plain[1:] & plain[:-1] & _member((points[:-1].astype(np.int64) << 21) | points[1:], p.pairs))
        cut[word_first] = True
        first = np.append(np.flatnonzero(cut), len(points))
        sums, inverse = _sums(points)
        h = (sums[first[1:]] - sums[first[:-1]]) * inverse[first[:-1]]
        distinct, at, where = np.unique(h, return_index=True, return_inverse=True)
        known = np.fromiter((self.parts.get(x, -1) for x in distinct.tolist()), np.int64, len(distinct))
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            known[fresh] = len(self.parts) + np.arange(len(fresh))
            self.parts.update(zip(distinct[fresh].tolist(), known[fresh].tolist(), strict=True))
            self._filter(points, first[:-1][at[fresh]], first[1:][at[fresh]], plain)
        n_parts = np.add.reduceat(cut.astype(np.int64), word_first)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.word_first = np.concatenate([self.word_first, len(self.word_parts) + np.cumsum(n_parts) - n_parts])
        self.word_size = np.concatenate([self.word_size, n_parts])
        self.word_parts = np.concatenate([self.word_parts, known[where]])

    def _filter(self, points, begin, end, plain) -> None:
        p, n = self.pieces, len(begin)
        base, last = np.empty(n, np.int64), np.empty(n, np.int64)
        ends, starts, ids, shares, nodes = [], [], [], [], self.nodes
        whole = np.flatnonzero(plain[begin])
        if len(whole):
            size = end[whole] - begin[whole]
            first = np.concatenate([[0], np.cumsum(size)])
            index = np.arange(first[-1]) + np.repeat(begin[whole] - first[:-1], size)
            e, s, k, w = lattices(points[index], first, p)
            base[whole] = nodes + first[:-1] + np.arange(len(whole))
            last[whole] = base[whole] + size
            ends.append(e + nodes), starts.append(s + nodes), ids.append(k), shares.append(w)
            nodes += int(first[-1]) + len(whole)
        for k in np.flatnonzero(~plain[begin]):  # a character in bytes: one way only
            spelled = [p.byte[x] for x in chr(points[begin[k]]).encode()]
            way = nodes + np.arange(len(spelled) + 1)
            base[k], last[k] = way[0], way[-1]
            ends.append(way[1:]), starts.append(way[:-1]), ids.append(np.array(spelled)), shares.append(np.ones(len(spelled)))
            nodes += len(way)
        ends, starts, ids, shares = (np.concatenate(x) for x in (ends, starts, ids, shares))
        run = np.cumsum(shares)
        head = np.concatenate([[True], ends[1:] != ends[:-1]])
        before = np.repeat((run - shares)[head], np.diff(np.append(np.flatnonzero(head), len(ends))))
        inside = np.minimum(run - before, 1.0)
        inside[np.append(np.flatnonzero(head)[1:] - 1, len(ends) - 1)] = 1.0
        arrive = np.zeros(nodes - self.nodes, np.int64)
        arrive[ends[head] - self.nodes] = len(self.upto) + np.flatnonzero(head)
        self.arrive = np.concatenate([self.arrive, arrive])
        self.upto = np.concatenate([self.upto, inside])
        self.start, self.piece = np.concatenate([self.start, starts]), np.concatenate([self.piece, ids])
        self.base, self.last = np.concatenate([self.base, base]), np.concatenate([self.last, last])
        self.nodes = nodes

    def __call__(self, keys: np.ndarray, texts: list[str]) -> list[np.ndarray]:
        if self.nodes > self.most:
            self._clear()
        split = []
        for t in texts:
            t = " " + t if t else ""
            split.append([" " + w for w in t[1:].split(" ")] if t and "  " not in t else _PART.findall(t))
        new = set().union(*split) - self.words.keys() if split else set()
        if new:
            self._learn(list(new))
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter((self.words[x] for s in split for x in s), np.int64, int(n_words.sum()))
        size = self.word_size[word]
        which = self.word_parts[np.arange(int(size.sum())) + np.repeat(self.word_first[word] - (np.cumsum(size) - size), size)]
        n_parts = np.bincount(np.repeat(np.arange(len(split)), n_words), size, minlength=len(split)).astype(np.int64)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        seed = mix64(np.repeat(mix64(keys.astype(U64) + U64(0x51)), n_parts) + place.astype(U64))
        node, base = self.last[which], self.base[which]
        live, steps, drawn = np.arange(len(which)), np.zeros(len(which), np.int64), []
        while len(live):
            u = (mix64(seed[live] + np.full(1, len(drawn) + 1, U64) * _A) >> U64(11)).astype(np.float64) * (0.999999999 / (1 << 53))
            e = self.arrive[node[live]]
            short = np.flatnonzero(self.upto[e] <= u)
            while len(short):  # the next way that reaches the node
                e[short] += 1
                short = short[self.upto[e[short]] <= u[short]]
            drawn.append((live, self.piece[e]))
            node[live] = self.start[e]
            steps[live] += 1
            live = live[node[live] > base[live]]
        ends = np.cumsum(steps)
        out = np.empty(int(steps.sum()), np.int64)
        for k, (at, piece) in enumerate(drawn):
            out[ends[at] - 1 - k] = piece
        size = np.zeros(len(split), np.int64)
        if len(which):
            np.add.at(size, np.repeat(np.arange(len(split)), n_parts), steps)
        return np.split(out, np.cumsum(size)[:-1]) if len(split) else []


def decode(ids, p: Pieces) -> bytes:
    """The UTF-8 bytes of a text from its piece ids."""
    return b"".join(map(p.raw.__getitem__, ids))[1:]


def encode(docs: DataFrame, path: str, theta: float = 1.0, shift: float = 10.0, block: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids (little-endian 32-bit), ids_crc32, lossless for every row of docs(doc_id, text)."""

    def run(batches):
        sample = Sampler(path, theta, shift)
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            keys, texts = np.asarray(ids.fill_null(0), np.int64), [t or "" for t in texts.to_pylist()]
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size < block):
                    size += len(texts[b])
                    b += 1
                found = sample(keys[a:b], texts[a:b])
                raw = [t.encode() for t in texts[a:b]]
                packed = [x.astype("<u4").tobytes() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array(map(len, raw), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(packed, pa.binary()),
                        pa.array([zlib.crc32(x) for x in packed], pa.int64()),
                        pa.array([decode(x.tolist(), sample.pieces) == r for x, r in zip(found, raw, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_pieces", "ids", "ids_crc32", "lossless"],
                )
                a = b

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids binary, ids_crc32 long, lossless boolean")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Adds text, what the ids (little-endian 32-bit) of each row spell; the inverse of encode(). Null ids give null."""

    def run(batches):
        p = pieces(path, 1.0, 10.0)
        for batch in batches:
            texts = [None if x is None else decode(np.frombuffer(x, "<u4").tolist(), p).decode() for x in columns(batch, "ids")[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    from pyspark.sql.types import StringType, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("text", StringType()))
