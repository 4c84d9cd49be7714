"""What the operators of this subpackage share: scratch tables, Arrow batches, Bloom filters."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioforge.llm.textbytes import U64, mix
from folioforge.shipping import ship

#: Arrow batches to Python end at this many bytes, so that a run of long texts stays small in memory.
BATCH_BYTES = 8 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package, and bound the bytes of an Arrow batch: rows alone (the default) say nothing about long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of our own, if driver and executors are one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioforge-"))
    return jsc.getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage: later stages read files that every executor reaches, and
    a lost executor costs no recomputation before this point.  The files go when
    the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folioforge-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)

    def clean() -> None:
        try:
            remove(spark, path.rsplit("/", 1)[0])
        except Exception:  # noqa: BLE001 the session may have ended
            pass

    atexit.register(clean)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path.rsplit("/", 1)[0]
    return table


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._folder)


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict | pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for a function that gives dicts of columns (or batches) for one input batch."""
    prepared(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in make(batch):
                    yield record(out, target)

    return df.mapInArrow(run, schema)


class Carried:
    """The columns of a table on their way through an operator, under names of their own (c0, c1, ...).

    So neither dots, blanks, backticks nor repeats in the names of other columns
    matter.  Columns named as a result (in any case, as Spark compares names) go.
    """

    def __init__(self, table: DataFrame, results: Iterable[str]):
        replaced = {r.lower() for r in results}
        kept = [(i, n) for i, n in enumerate(table.columns) if n.lower() not in replaced]
        self.columns, self.names = [f"c{i}" for i, _ in kept], [n for _, n in kept]
        self.frame = table.toDF(*[f"c{i}" for i in range(len(table.columns))]).select(*self.columns)
        self.fields = list(self.frame.schema)

    def __getstate__(self) -> dict:
        return {"columns": self.columns, "names": self.names}  # what workers need

    def at(self, name: str) -> int:
        """The place of an input column among those kept."""
        exact = [i for i, n in enumerate(self.names) if n == name]
        return (exact or [i for i, n in enumerate(self.names) if n.lower() == name.lower()])[0]

    def __getitem__(self, name: str) -> str:
        return self.columns[self.at(name)]

    def batch(self, batch: pa.RecordBatch, lo: int = 0, n: int | None = None) -> dict:
        """The kept columns of rows of a batch that begins with them."""
        return {c: batch.column(i).slice(lo, n) for i, c in enumerate(self.columns)}

    def schema(self, results: str) -> T.StructType:
        return T.StructType([*self.fields, *T.StructType.fromDDL(results)])

    def named(self, df: DataFrame, results: list[str]) -> DataFrame:
        """The kept columns under their names again, then the results."""
        return df.select(*self.columns, *results).toDF(*self.names, *results)


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((columns[f.name], f) for f in schema)]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def longs(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs that Spark has."""
    return x.view(np.int64)


# Bloom filters ---------------------------------------------------------------------------


def bloom_bits(hashes: np.ndarray, log2_bits: int, probes: int) -> np.ndarray:
    """The (probes, n) bit positions of 64-bit hashes."""
    second = mix(hashes + U64(0x632BE59BD9B4E019)) | U64(1)
    return np.stack([(hashes + U64(i) * second) >> U64(64 - log2_bits) for i in range(probes)]).astype(np.int64)


def bloom_has(filter_bits: np.ndarray, hashes: np.ndarray, log2_bits: int, probes: int) -> np.ndarray:
    at = bloom_bits(hashes, log2_bits, probes)
    return ((filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def packed(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def bloom_build(hashes: DataFrame, log2_bits: int, probes: int, chunk_bytes: int = 1 << 18) -> np.ndarray:
    """A Bloom filter (one bit array of ``2**log2_bits``) of the one column of 64-bit hashes of ``hashes``.

    Each task sends only the chunks it set bits in, compressed; the merged filter
    has a fixed size whatever the input, so its broadcast is bounded.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << log2_bits) >> 3, np.uint8)
        for b in batches:
            at = bloom_bits(b.column(0).to_numpy(zero_copy_only=False).view(U64), log2_bits, probes).ravel()
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield from filter_chunks([bits], chunk_bytes)

    rows = merged_filters(hashes.mapInArrow(partial, FILTER_SCHEMA), 1, log2_bits, chunk_bytes)
    return rows[0]


FILTER_SCHEMA = "chunk int, bits array<binary>"


def filter_chunks(filters: list[np.ndarray], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """The non-empty chunks of a task's filters, compressed, one row a chunk."""
    for k in range(0, -(-len(filters[0]) // chunk_bytes)):
        parts = [f[k * chunk_bytes : (k + 1) * chunk_bytes] for f in filters]
        if any(p.any() for p in parts):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([[packed(p) for p in parts]], pa.list_(pa.binary()))], names=["chunk", "bits"]
            )


def merged_filters(rows: DataFrame, n: int, log2_bits: int, chunk_bytes: int) -> list[np.ndarray]:
    """Merge the tasks' filters chunk by chunk: ``n`` = 1 is a plain union; ``n`` = 2 is (once-seen, twice-seen).

    For two filters a bit that two tasks saw once is one that was seen twice.  A
    chunk's rows (one a task) are merged one after the other in bounded memory.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc = None, []
        for b in batches:
            for k, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = [unpacked(x) for x in bits]
                if k != now:
                    if now is not None:
                        yield out(now, acc)
                    now, acc = k, [p.copy() for p in part]
                    continue
                if n == 2:
                    acc[1] |= part[1] | (acc[0] & part[0])
                acc[0] |= part[0]
        if now is not None:
            yield out(now, acc)

    def out(k: int, acc: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([[packed(a) for a in acc]], pa.list_(pa.binary()))], names=["chunk", "bits"])

    filters = [np.zeros((1 << log2_bits) >> 3, np.uint8) for _ in range(n)]
    chunks = max(1, len(filters[0]) // chunk_bytes)
    placed = rows.repartition(min(chunks, 32), "chunk").sortWithinPartitions("chunk")
    for row in placed.mapInArrow(merge, FILTER_SCHEMA).toLocalIterator():
        for f, part in zip(filters, row["bits"], strict=True):
            f[row["chunk"] * chunk_bytes : row["chunk"] * chunk_bytes + chunk_bytes] = unpacked(part)
    return filters
