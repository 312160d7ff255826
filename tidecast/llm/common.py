"""Helpers shared by the operators: input tables, written intermediate tables, text hashing.

Intermediate tables are Parquet files below the shared checkpoint folder of the session, so a
lost executor costs a re-read and no recomputed lineage. They are removed when the
application ends, or earlier where an operator knows that nothing reads them any more.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidecast.session import ensure_checkpoint_dir, ship_package

_WRITTEN: dict[str, tuple[SparkSession, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Written tables of one operator call; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{self.n:03d}-{name}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        _WRITTEN[path] = (self.spark, path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(t.scratch_path)


def _remove(path: str) -> None:
    spark, _ = _WRITTEN.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_WRITTEN):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session has ended before
            _WRITTEN.pop(path, None)


# ---------------------------------------------------------------- words of Arrow string arrays

_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text hashed at a time; bounds the memory of a task whatever the length of a text.
PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of MurmurHash3: a bijection, applied to each element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word in ``data``; no word crosses one of ``starts`` (text begins)."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[starts[starts < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cut = starts[(starts > 0) & (starts <= len(data))]
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hash_piece(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = _LOWER[data]
    begin, end = word_spans(data, starts)
    if not len(begin):
        return np.empty(0, np.uint64), begin, end
    up, down = _powers(len(data))
    value = _BYTE[data]
    value *= up[: len(data)]
    total = np.cumsum(value)
    h = (total[end - 1] - total[begin] + value[begin]) * down[begin]
    return mix(h + np.uint64(_ODD) * (end - begin).astype(np.uint64)), begin, end


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of rows as (first row, word hashes, word offsets per row), words lower-cased.

    A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r; A-Z count as a-z.
    Rows are taken together up to PIECE bytes; a longer text is hashed in pieces that end at
    white space, so no more than a piece (or one word) is worked on at a time.
    """
    if not len(column):
        return
    data, off = texts(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, "right")) - 1)
        if off[last] - off[row] <= PIECE:
            h, begin, _ = _hash_piece(data[off[row] : off[last]], off[row:last] - off[row])
            yield row, h, np.searchsorted(begin, off[row : last + 1] - off[row])
        else:
            parts, at = [], int(off[row])
            while at < off[last]:
                to = min(at + PIECE, int(off[last]))
                while to < off[last] and not _SPACE[data[to]]:
                    gap = np.flatnonzero(_SPACE[data[to : to + 4096]])
                    to = min(to + (int(gap[0]) if len(gap) else 4096), int(off[last]))
                parts.append(_hash_piece(data[at:to], np.zeros(1, np.int64))[0])
                at = to
            h = np.concatenate(parts)
            yield row, h, np.array([0, len(h)])
        row = last


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(_ODD) + words[i : n - width + 1 + i])
    return np.unique(h)
