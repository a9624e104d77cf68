"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Words whose hashes a task remembers before it starts afresh.
MAX_CACHED_WORDS = 300_000

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="skylattice-"))
    return got


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_path = path
    return again


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by stored(), once nothing reads them any more: what a result still reads has to stay."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of a row but maps and variants, which Spark doesn't hash."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of position hashes; bytes whose word hashes are made at once.
BASE, HASHED = 0x9E3779B97F4A7C15 | 1, 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(2 * HASHED, 1 << n.bit_length())
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def hashed_words(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and how many words each text has.

    A word's hash is a difference of prefix sums of its bytes' codes, made for many words at once."""
    data = np.frombuffer(b" ".join([b"", *batch, b""]), np.uint8)  # a blank before, between and after
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        first = start[i]
        j = max(i + 1, int(np.searchsorted(end, first + HASHED, "right")))
        n = int(end[j - 1] - first)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data[first : first + n]] * up[:n], out=sums[1:])
        a, z = start[i:j] - first, end[i:j] - first
        out[i:j] = mix64((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))
        i = j
    ends = np.cumsum([0] + [len(t) + 1 for t in batch])
    return out, np.diff(np.searchsorted(start, ends))


def texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; nulls count as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


_TRIM: list = []


def give_back() -> None:
    """Return to the system what is free; the C library keeps what large arrays leave behind, and a worker outlives its tasks."""
    if not _TRIM:
        try:
            _TRIM.append(ctypes.CDLL(None).malloc_trim)
        except (AttributeError, OSError, TypeError):  # not the GNU library
            _TRIM.append(lambda _: 0)
    _TRIM[0](0)


def slices(batches, rows: int = 1000):
    """Record batches of at most so many rows, which bounds what a task holds; what is free goes back after each."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
            give_back()


def gathered(batches, column: int, most: int, rows: int = 2000):
    """Slices of record batches whose texts in a column come to about so many bytes."""
    import pyarrow.compute as pc

    for b in slices(batches, rows):
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at, done = 0, 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, done + most)) + 1)
            yield b.slice(at, end - at)
            give_back()
            at, done = end, int(ends[min(end, b.num_rows) - 1])


def words_count(text) -> Column:
    """Words of a text column; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
