"""Pieces shared by the text operators: words, shared storage, packed arrays, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words, and the class of all others.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """UTF-8 words; bytes.split() separates at exactly the characters of SPACES. Null: none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words(), A-Z lower-cased; bytes.lower() leaves all other letters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def space_parts(text: Column) -> Column:
    """What stands between each two of SPACES, empty parts too, on the JVM; null text gives one empty part."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ")


def word_array(text: Column) -> Column:
    """Words as an array, on the JVM; null text gives an empty array."""
    return F.filter(space_parts(text), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shielded(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but `keep` under numbers for names, which clash with nothing, and what restores columns and order."""
    to = {c: f"column {i}" for i, c in enumerate(docs.columns) if c not in keep}
    back = lambda df: df.select(*[F.col(f"`{to.get(c, c)}`").alias(c) for c in docs.columns])
    return docs.withColumnsRenamed(to), back


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Set here only where unset, on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written by materialise() in this process, in order.
WRITTEN: list[str] = []


def discard(spark: SparkSession, begin: int) -> None:
    """Deletes tables written from place `begin` of WRITTEN on, but for the last: what a caller needs no more."""
    for path in WRITTEN[begin:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del WRITTEN[begin:-1]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors.

    The files stay under <spark.checkpoint.dir>/llm/ until discard() or whoever clears that folder.
    """
    path = f"{shared_dir(df.sparkSession)}/llm/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of strings that map_rows() hands over at once; a longer row comes alone.
BATCH_BYTES = 8 << 20


def slices(b: pa.RecordBatch, most_rows: int, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """b in parts of at most most_rows rows whose strings take most_bytes at most, or single rows."""
    size = np.zeros(b.num_rows, np.int64)
    for c in b.columns:
        if any(t(c.type) for t in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < b.num_rows:
        stop = int(np.searchsorted(ends, most_bytes + (ends[at - 1] if at else 0), side="right"))
        stop = max(at + 1, min(stop, at + most_rows))
        yield b.slice(at, stop - at)
        at = stop


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, batch: int = 500) -> DataFrame:
    """mapInArrow over whole partitions: fn gets dicts of columns (lists) of at most `batch` rows and BATCH_BYTES and yields the same kind.

    schema is a DDL string.
    """
    arrow = to_arrow(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(part.to_pydict() for b in batches for part in slices(b, batch)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def to_arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def reducers(df: DataFrame, rows: int, per: int = 4 << 20) -> int:
    """Parts for an exchange of so many values: one for each `per` of them, so each stays the same size as data grow, without a bound."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))


def cuts(hashes: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Where sorted hashes of so many bits pass from one of n equal ranges to the next."""
    return np.searchsorted(hashes, np.array([(i << bits) // n for i in range(1, n)], np.uint64)) if n > 1 else np.empty(0, np.int64)


def map_parts(df: DataFrame, n: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over all rows of each value 0 .. n - 1 of the column part, each a task of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f for f in frames if len(f)]
        if own:
            yield fn(pd.concat(own, ignore_index=True))

    return df.repartitionById(n, F.col("part")).mapInPandas(run, schema)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Integer arrays as one frame; bytes of equal place stand together, which suits sorted values. Frames that are not tiny are compressed."""
    out = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        out.append(f"{a.dtype.str:<8}{len(a):<16}".encode())
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    raw = b"".join(out)
    return raw if len(raw) < 256 else zstandard.ZstdCompressor(level=level).compress(raw)


def unpack(data: bytes) -> list[np.ndarray]:
    """pack() undone; a compressed frame begins with its own mark, a tiny one with a count that is not that."""
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31) if data[:4] == zstandard.FRAME_HEADER else data
    n, at, out = int(np.frombuffer(raw[:8], "<i8")[0]), 8, []
    for _ in range(n):
        dtype, size = np.dtype(raw[at : at + 8].decode().strip()), int(raw[at + 8 : at + 24])
        at += 24
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(size))
        at += size * dtype.itemsize
    return out


def delta(a: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned values; the first stays."""
    return np.diff(a, prepend=a.dtype.type(0)) if len(a) else a


def undelta(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)
