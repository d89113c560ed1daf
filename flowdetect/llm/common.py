"""Shared helpers: scratch tables, text batches as byte arrays, word and n-gram hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdetect.session import scratch_path

#: Bytes of text handled by one numpy pass; a longer document is one pass of its own.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, release: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared scratch folder and read it back.

    The written table cuts the lineage: a lost executor costs only the tasks of
    later steps. The folder is removed when the session ends. ``release``: drop the
    shuffle files of the steps up to here, for steps that shuffle much. ``paths``
    gets the folder, for a caller that removes it sooner.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if paths is not None:
        paths.append(path)
    if release:
        release_shuffles(spark)
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs.

    It follows the driver's garbage collection: once for the plans that
    finished, and once more for those that Spark's listeners still held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def lean(run):
    """A batch generator that hands freed memory back to the system when its task ends: Python workers are reused."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


# ---------------------------------------------------------------- hashing

_U = np.uint64
GOLD = _U(0x9E3779B97F4A7C15)
_M1 = _U(0xBF58476D1CE4E5B9)
_M2 = _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = x + GOLD
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    return mix(np.arange(n, dtype=np.uint64) * GOLD + _U(seed))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class RangeHash:
    """Hashes of byte ranges, eight bytes a step, each step mixed before the next.

    Nothing in it is linear, so strings built of swapped halves do not meet, as they do in
    polynomials modulo 2**64. Ranges beyond ``LONG`` bytes are hashed one at a time.
    """

    LONG = 256

    def __init__(self, seed: int = 0):
        self.seed = _U(stream(29, seed + 1)[seed])

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        length = end - start
        out = mix(self.seed ^ (length.astype(np.uint64) * GOLD))
        long = length > self.LONG
        for at in np.flatnonzero(long).tolist():
            digest = hashlib.blake2b(data[start[at] : end[at]].tobytes(), digest_size=8).digest()
            out[at] = mix(out[at : at + 1] ^ _U(int.from_bytes(digest, "little")))[0]
        active = np.flatnonzero(~long & (length > 0))
        done = 0
        while len(active):
            left = np.minimum(length[active] - done, 8).astype(np.uint64)
            chunk = eight[start[active] + done] & (_U(0xFFFFFFFFFFFFFFFF) >> ((_U(8) - left) << _U(3)))
            out[active] = mix(out[active] ^ chunk)
            done += 8
            active = active[length[active] > done]
        return out


class RollingHash:
    """Polynomial hashes of byte ranges, modulo 2**64, from one prefix sum.

    For ranges that overlap all along a text. Some strings of 1024 bytes and more
    are known to meet, so it serves shorter ranges, or routing only.

    hash(s, e) = (prefix[e] - prefix[s]) * base**-s; the base is odd, so its
    inverse exists. Powers are kept for the longest input seen.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        self.table = stream(11, 256)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        self.pow, self.inv = (np.full(n, _U(b)) for b in (self.BASE, inverse))
        self.pow[0] = self.inv[0] = 1
        np.multiply.accumulate(self.pow, out=self.pow)
        np.multiply.accumulate(self.inv, out=self.inv)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.pow):
            self._grow(1 << (len(data) + 1).bit_length())
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.pow[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64) * GOLD)


# ---------------------------------------------------------------- text batches

#: White space of every contract here: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, nulls as empty; offsets has len + 1 entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most ``limit`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) for bounded runs of rows; every text whole."""
    data, offsets = text_buffer(column)
    for lo, hi in slices(offsets, limit):
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts: document, byte range, hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, roll: RangeHash):
        n = len(data)
        word = ~IS_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = roll.ranges(data, self.start, self.end)
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])


def ngram_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` consecutive words inside one document, and each window's first word."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    factor = stream(101 + n, n) | _U(1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out += words[k : k + size] * factor[k]
    at = np.flatnonzero(doc[:size] == doc[n - 1 :])
    return mix(out[at]), at


def string_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary()).cast(pa.string())


def crc32_long(column) -> F.Column:
    return F.crc32(column).cast("long")
