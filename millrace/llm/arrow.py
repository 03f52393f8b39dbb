"""Running Arrow functions over documents, and word arithmetic on the bytes of many texts at once."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20  # text handled at once; bounds the memory of the number arrays
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_shipped: set[str] = set()
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as Spark does with any Python file."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def unused(columns: list[str], name: str) -> str:
    """The name, or a longer one, that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def map_texts(
    docs: DataFrame,
    columns: list,
    per_slice: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    at_end: Callable[[], None] = lambda: None,
) -> DataFrame:
    """``per_slice`` over slices of a bounded number of text bytes; the text is the last of ``columns``.

    A null text arrives as an empty one. ``at_end`` is called when a task has no more rows; then the worker's free
    memory goes back to the machine, since idle workers stand beside those of the next stage.
    """
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield per_slice(part)
        at_end()
        release()

    source = docs.select(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(columns, names)])
    text = names[-1]
    return source.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(run, schema)


def release() -> None:
    """Give memory that is free back to the machine, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch, by the size of its last column, into runs of rows; a row is never cut."""
    if not batch.num_rows:
        return
    ends = utf8(batch.column(batch.num_columns - 1))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; one more offset marks the end."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(ends[-1] - ends[0])
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if size else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        factors = np.full(max(n, 1 << 16), np.uint64(base))
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a 64-bit finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any byte range follows; see ``range_hash``."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", len(raw) + 1)[: len(raw)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start up to each end, the same wherever they stand.

    Long ranges with unlike bytes can be made to collide, so it is for boundaries and features, not for equality.
    """
    return (sums[ends] - sums[starts]) * _power("down", len(sums))[starts]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (plus the end)."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    last[tails] |= inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def split_words(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the first word of each text (plus the end)."""
    raw, offsets = utf8(column)
    data, found, heads = raw.tobytes(), [], [0]
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        found += data[a:b].split()
        heads.append(len(found))
    return found, np.array(heads)


def hash_words(found: list[bytes]) -> np.ndarray:
    """A hash of each word that does not rest on sums of its bytes, so no pattern of letters makes words collide."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def gram_hash(word_hash: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by the index of its first word."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(_BASE) + word_hash[j : j + n]
    return mix(total)


def run_hash(word_hash: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of ``n`` words from each ``first`` on, whatever their number."""
    sums = np.zeros(len(word_hash) + 1, np.uint64)
    np.cumsum(word_hash * _power("up", len(sums))[:-1], out=sums[1:])
    return mix((sums[first + n] - sums[first]) * _power("down", len(sums))[first] + n.astype(np.uint64))
