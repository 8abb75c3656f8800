"""Token ids in seekable zstandard files.

A file holds the documents of one range of doc_id in ascending order, one zstandard frame each
(ids as little-endian unsigned 32-bit integers, with zstandard's content checksum). Then come two
skippable frames: the doc_ids as 64-bit integers (the smallest one stands for null), and the seek
table of zstandard's seekable format: compressed and raw size and a 32-bit checksum per frame,
then the number of frames, a flag byte and the magic number. A reader takes the footer, the table
and only the frames it needs.

Pre-tokens are encoded once per worker while they last in a bounded cache: the tokenizer never merges
across white space, nor between letters, digits and signs. Words with characters for which that may not
hold (apostrophes, beyond Latin-1) are encoded as words; texts with special strings, and all texts where the
tokenizer's normalizer or pre-tokenizer is another than the one this was checked with, go to the library whole.

Files are written by tasks to a folder that all executors share, under a name of the attempt's
own, and a written manifest lists the ones that count, so that lost and repeated tasks do no harm.
Defined cases: a null or empty text has the end id only; repeated doc_ids are kept, in a stable
order; null doc_ids come first; no rows make no files; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, columns, materialize, scratch, utf8
from .token_counts import tokenizer

_SKIP_IDS, _SKIP_SEEK, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_NULL_ID = -(1 << 63)

#: The normalizer and the pre-tokenizer that allow to cut texts into words, and plain words by kinds of characters.
_SPLITS_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
_ODD, _SPACE, _LETTER, _DIGIT, _SIGN = range(5)


def _table(dtype, values: dict) -> np.ndarray:
    table = np.zeros(256, dtype)
    for v, codes in values.items():
        table[list(codes)] = v
    return table


#: The kind of a byte by itself. The apostrophe is odd, as 's and the like are pre-tokens; so is what isn't ASCII, but for Latin-1's letters.
_KINDS = _table(np.uint8, {_SPACE: [0x20, *range(0x09, 0x0E)], _LETTER: [*range(0x41, 0x5B), *range(0x61, 0x7B)], _DIGIT: range(0x30, 0x3A), _SIGN: [*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]})
#: The second bytes, after 0xC3, of the letters from U+00C0 to U+00FF.
_LATIN = _table(bool, {True: [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]})
_LOWER, _LOWER_LATIN = (np.arange(256, dtype=np.uint8) for _ in range(2))
_LOWER[0x41:0x5B] += 0x20
_LOWER_LATIN[0x80:0x9F] += 0x20


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class WordEncoder:
    """Ids of whole texts, by way of a cache of their units, which starts anew beyond `most` entries.

    A unit is a pre-token of plain characters in lower case, else a word, else a text that may not be cut. They are found
    with numpy over the bytes of a block and told apart by Arrow, so that only the block's distinct units become Python
    objects; new ones go to the library, those of plain characters many at once, as it marks each pre-token's last id.
    """

    def __init__(self, path: str, most: int = 800_000):
        self.library, self.most = tokenizer(path), most
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        self.splits = (spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"], model["type"], model.get("end_of_word_suffix"), model.get("dropout")) == (*_SPLITS_WORDS, None, "BPE", "</w>", None)
        self.splits = self.splits and not any(t["normalized"] for t in added)
        self.special = [t["content"].encode() for t in added]
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces = Tokenizer.from_str(self.library.to_str())
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _whole(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit) as the library gives them for each by itself."""
        ids, sizes, a = [], [], 0
        while a < len(units):
            b, size = a, 0
            while b < len(units) and b - a < 4096 and (b == a or size < 1 << 16):
                size += len(units[b])
                b += 1
            for e in self.library.encode_batch_fast(units[a:b], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                sizes.append(len(ids[-1]))
            a = b
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(sizes, np.int32)

    def _plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for short pre-tokens of plain characters in lower case: nothing is left to normalise in them."""
        joined = (" ".join(units[i : i + 256]) for i in range(0, len(units), 256))
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(self.pieces.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in joined)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(units):  # a vocabulary that lacks a character's last form
            return self._whole(units)
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def _units(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with plain units in lower case, where units begin, their kinds); they cover all bytes, white space too."""
        n = len(raw)
        kind = _KINDS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[_LATIN[raw[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        at = np.zeros(n, bool)
        at[off[off < n]] = True
        begins = at | (kind == _DIGIT)
        begins[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(begins).astype(np.int32)  # a text of Spark's has less than 2^31 bytes
        kinds, first = kind[begin], at[begin]
        head = first | (kinds == _SPACE)
        head[1:] |= kinds[:-1] == _SPACE
        word = np.cumsum(head, dtype=np.int32) - 1
        odd = np.zeros(int(word[-1]) + 1, bool)
        odd[word[kinds == _ODD]] = True
        odd = odd[word]
        if self.splits:
            whole = np.zeros(len(off) - 1, bool)
            text = raw.tobytes()
            for s in self.special:
                if s in text:
                    whole |= [s in text[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            del text
        else:
            whole = np.ones(len(off) - 1, bool)
        if whole.any():
            inside = whole[np.searchsorted(off, begin, side="right") - 1]
            odd, head = odd | inside, np.where(inside, first, head)
        kinds[odd] = _ODD
        kept = head | ~odd
        begin, kinds = begin[kept], kinds[kept]
        low = _LOWER[raw]
        low[lead + 1] = _LOWER_LATIN[raw[lead + 1]]
        if odd.any():
            low = np.where(np.repeat(kinds == _ODD, np.diff(begin, append=n)), raw, low)
        return low, begin, kinds

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end) of texts with these bytes and offsets into them."""
        if len(self.known) > self.most:
            self.clear()
        raw, off = raw[off[0] : off[-1]], off - off[0]
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        low, begin, kinds = self._units(raw, off)
        ends = np.append(begin, np.int32(len(raw)))
        found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(low)).dictionary_encode()
        codes, units = found.indices.to_numpy(), found.dictionary.to_pylist()
        del low, ends
        place = np.fromiter(map(self.known.get, units, repeat(-1)), np.int32, len(units))
        kind = np.empty(len(units), np.uint8)
        kind[codes] = kinds
        short = np.fromiter(map(len, units), np.int64, len(units)) <= 64
        new = place < 0
        blank, odd = kind == _SPACE, kind == _ODD
        plain, odd, long = (np.flatnonzero(new & ~blank & x) for x in (short & ~odd, short & odd, ~short))
        parts = [self._plain([units[i] for i in plain.tolist()]), self._whole([units[i] for i in [*odd.tolist(), *long.tolist()]])]
        flat, sizes = np.concatenate([self.flat, *(p[0] for p in parts)]), np.concatenate([self.sizes, *(p[1] for p in parts), np.zeros(1, np.int32)])
        order = np.concatenate([plain, odd, long])
        place[order] = len(self.sizes) + np.arange(len(order))
        place[blank] = len(sizes) - 1
        kept = len(self.sizes) + len(plain) + len(odd)  # long units are forgotten with the block
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        k = place[codes]
        lengths = sizes[k]
        before = np.zeros(len(k) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        take = np.repeat(starts[k] - before[:-1], lengths)
        take += np.arange(len(take))
        ids = flat[take]
        del take
        self.known.update(zip([units[i] for i in order[: len(plain) + len(odd)].tolist()], range(len(self.sizes), kept), strict=True))
        self.flat, self.sizes = flat[: starts[kept]].copy(), sizes[:kept].copy()
        return ids, before[np.searchsorted(begin, off)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker, which serves many tasks."""
    return WordEncoder(path)


class Writer:
    def __init__(self, stream):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.table, self.ids = [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        import xxhash

        frame = self.zstd.compress(raw)
        self.stream.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(_NULL_ID if doc_id is None else doc_id)

    def close(self) -> None:
        ids = np.array(self.ids, "<i8").tobytes()
        table = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIP_IDS, len(ids)) + ids + struct.pack("<II", _SKIP_SEEK, len(table)) + table)
        self.stream.close()


class Reader:
    """Random access to a file: only the frames asked for are read and decompressed."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = file_system(uri)
        self.file, self.zstd = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table")
        begin = size - 9 - 12 * n
        self.table = np.frombuffer(self._at(begin, 12 * n), "<u4").reshape(n, 3)
        self.ids = np.frombuffer(self._at(begin - 8 - 8 * n, 8 * n), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])

    def _at(self, where: int, size: int) -> bytes:
        self.file.seek(where)
        return self.file.read(size)

    def raw(self, k: int) -> bytes:
        import xxhash

        raw = self.zstd.decompress(self._at(int(self.starts[k]), int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def document(self, doc_id: int) -> np.ndarray:
        k = int(np.searchsorted(self.ids, doc_id))
        if k == len(self.ids) or self.ids[k] != doc_id:
            raise KeyError(doc_id)
        return np.frombuffer(self.raw(k), "<u4")

    def frames(self) -> Iterator[tuple[int | None, bytes]]:
        for k, i in enumerate(self.ids.tolist()):
            yield (None if i == _NULL_ID else i), self.raw(k)


def write_token_files(docs: DataFrame, path: str, end_id: int | None, folder: str | None = None, block: int = 8 << 20, file_bytes: int = 256 << 20) -> DataFrame:
    """Encode docs(doc_id, text) and write the files; returns their manifest (shard, part, file, n_docs, n_tokens).

    A shard begins another part once the ids of a file take `file_bytes`; shards and parts follow each other in the order of doc_id.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")

    def write(batches):
        from pyspark import TaskContext

        encode, shard = word_encoder(path), TaskContext.get().partitionId()
        run, part, writer, uri, n_tokens = uuid.uuid4().hex[:8], 0, None, "", 0
        end = [] if end_id is None else [end_id]

        def entry():
            writer.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "file": [uri], "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            doc_ids, (raw, off) = doc_ids.to_pylist(), utf8(texts)
            for a, b in chunks(off, block):
                tokens, places = encode(raw, off[a : b + 1])
                for i, begin, stop in zip(doc_ids[a:b], places[:-1].tolist(), places[1:].tolist(), strict=True):
                    if writer is None:
                        uri, n_tokens = f"{folder}/tokens-{shard:06d}-{part:05d}-{run}.zst", 0
                        fs, p = file_system(uri)
                        fs.create_dir(p.rpartition("/")[0], recursive=True)
                        writer = Writer(fs.open_output_stream(p, compression=None))
                    x = np.append(tokens[begin:stop], end).astype("<u4")
                    n_tokens += len(x)
                    writer.add(i, x.tobytes())
                    if 4 * n_tokens >= file_bytes:
                        yield entry()
                        part, writer = part + 1, None
        if writer:
            yield entry()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "shard int, part int, file string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files themselves."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))

    def read(batches):
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in columns(batch, "file", "base")), strict=True):
                rows = []
                for doc_id, raw in Reader(uri).frames():
                    rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw)))
                    start += len(raw) // 4
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(n, "shard", "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
