"""What the corpus operators share: scratch tables and vectorised word hashing.

Text columns arrive in Arrow batches; words are found and hashed with numpy over
the UTF-8 bytes of many documents at once, so no Python object is made per word.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the session names in spark.checkpoint.dir.

    Where that setting is absent, a temporary folder is used if the driver and all tasks are one
    machine's; on a cluster it is an error, as executors couldn't read each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="termlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/termlake-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors.

    group_rows: rows of a row group at most, for rows of some MB; Spark's reader holds a row group of such rows at once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**{"parquet.block.row.count.limit": group_rows} if group_rows else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, once nothing will read it again."""
    from pyarrow import fs as pfs

    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        fs, path = pfs.FileSystem.from_uri(folder.replace("file:///", "file:/").replace("file:/", "file:///", 1))
        fs.delete_dir(path)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds what Spark sends a Python worker at once by bytes, where the session has no bound: ten thousand long rows would be tens of MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit; works in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges [a, b) of consecutive texts with at most `limit` bytes, at least one text each."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def byte_table(separators) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words are runs of anything but ASCII white space.
SPACE_WORDS = byte_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of a-z, 0-9 and everything beyond ASCII (after lower-casing A-Z).
PLAIN_WORDS = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_STEP = U64(0x9E3779B97F4A7C15)
_UNSTEP = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _letters(seed: int = 7) -> np.ndarray:
    table = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))
    table[65:91] = table[97:123]
    return table


class WordHasher:
    """64-bit hashes of the lower-cased (A-Z) words of a chunk of texts."""

    def __init__(self, word_bytes: np.ndarray):
        self.word_bytes, self.letters = word_bytes, _letters()
        self.powers = self.unpowers = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, 2 * CHUNK_BYTES)
            step = np.full(size, _STEP)
            step[0] = U64(1)
            self.powers = np.cumprod(step, dtype=U64)
            step[1:] = _UNSTEP
            self.unpowers = np.cumprod(step, dtype=U64)

    def __call__(self, data: np.ndarray, off: np.ndarray):
        """(hashes, starts, ends, first): words in text order; first[i] is text i's first word, first[-1] the count."""
        lo, hi = int(off[0]), int(off[-1])
        raw, rel = data[lo:hi], off - lo
        n = hi - lo
        if not n:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        self._grow(n)
        inside = self.word_bytes[raw]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[rel[:-1][rel[:-1] < n]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        cut = rel[1:] - 1
        after[cut[cut >= 0]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(n + 1, U64)
        np.cumsum(self.letters[raw] * self.powers[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.unpowers[starts]
        hashes += (ends - starts).astype(U64) * U64(0xA0761D6478BD642F)
        return mix64(hashes), starts, ends, np.searchsorted(starts, rel)


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def held(batches, size: int):
    """Tables of about `size` bytes, from smaller and larger record batches; rows stay whole and in order."""
    kept, n = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            kept.append(part)
            n += part.nbytes
            if n >= size:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, n = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()
