"""What the text operators share: scratch tables, blocks of Arrow text, word bounds and hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trackgrid.scale import new_path

#: Most bytes of text that a task looks at in one step (one row may be longer).
BLOCK_BYTES = 1 << 20
#: Longest tables of powers that a task keeps.
_KEPT_POWERS = 4 << 20

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
#: ASCII lower-casing of UTF-8 bytes; bytes of other characters stay.
LOWER = _UPPER

#: Bytes of words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words of ASCII letters and digits and of all other characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Scratch:
    """Tables in the shared folder that live as long as a loop needs them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df``, cut its lineage and scan it back; survives lost executors."""
        path = new_path(self.spark, f"{self.tag}-{name}")
        df.write.parquet(path)
        self.paths[name] = [*self.paths.get(name, []), path]
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str, keep: int = 0) -> None:
        """Delete the tables written under ``name``, but for the last ``keep``."""
        old = self.paths.get(name, [])
        cut = len(old) - keep
        jvm = self.spark._jvm
        for path in old[:cut]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.paths[name] = old[cut:]


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that the table does not have."""
    return prefix if prefix not in taken else f"{prefix}_{uuid.uuid4().hex[:8]}"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES):
    """Yield ``(first row, rows, bytes, starts)`` over runs of rows of at most ``most`` bytes, one row at least.

    ``starts`` has one entry more than the run has rows; NULL is empty text.
    """
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], kind)[text.offset:text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end - row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray):
    """Starts, ends and rows of the words of a block; no word crosses rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(starts, begins, side="right") - 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(seed: int, n: int):
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = _BASES[seed]
        size = max(n, 1 << 16)

        def row(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        have = (row(base), row(pow(base, -1, 1 << 64)))
        if size <= _KEPT_POWERS:
            _POWERS[seed] = have
    return have


class SpanHash:
    """Hashes of any spans of a sequence of 64-bit values, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        power, self.inverse = _powers(seed, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def byte_values(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A random-looking 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D + 2 * seed))[data]


def arrow_type(kind) -> pa.DataType:
    """Arrow's type for a Spark type, as Spark sends it to tasks."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_text(df: DataFrame, function, new: str, keep: list[str]) -> DataFrame:
    """Run ``function(batch) -> [arrays]`` on Arrow batches and add its columns ``new`` (DDL) to ``keep``.

    ``function`` may be a callable that makes the function, once per task.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    out = StructType([df.schema[c] for c in keep] + list(added))
    kinds = [arrow_type(f.dataType) for f in added]
    names = keep + added.names

    def task(batches):
        work = function()
        for batch in batches:
            arrays = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) and a.type == k else pa.array(a, k) for a, k in zip(work(batch), kinds)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(kept + arrays, names=names)

    return df.mapInArrow(task, out)
