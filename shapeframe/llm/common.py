"""What the operators share: word pattern, lineage cuts and size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes up to which a side may be broadcast. Sides are counted before; above either a shuffled join runs.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20
#: Rows and bytes that a task reads of a counted frame, about, where it would read fewer.
PART_ROWS, PART_BYTES = 50_000, 8 << 20
#: Bytes of an Arrow batch that goes to a worker.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all runs on this machine, as in tests.

    ``shapeframe.lineage`` holds the same for the engine: this subpackage and the rest can each be taken away.
    """
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return folder.get()


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the cluster's shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame) -> DataFrame:
    """cut(df), its rows and bytes counted as they are written: ``small``, ``empty`` and ``Sieve`` then need no job of their own.

    It comes in no more partitions than PART_ROWS and PART_BYTES ask for, whatever the number of a shuffle's: a frame of few
    rows costs its readers few tasks, and if it is in one partition, no shuffle to group or join it.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_row_width(df)).alias("bytes")))
    rows, total = seen.get["rows"], seen.get["bytes"] or 0
    out = out.coalesce(max(1, -(-rows // PART_ROWS), -(-total // PART_BYTES)))
    out._rows_bytes = rows, total
    return out


def empty(df: DataFrame) -> bool:
    """Whether it has no rows; for a counted frame, without a job."""
    known = vars(df).get("_rows_bytes")
    return not (known[0] if known else df.limit(1).count())


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nobody holds any more, instead of when memory happens to run low."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.coalesce(F.array_size(value), F.lit(0)).cast("long") * 8 + 32
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(32).cast("long"), lambda n, x: n + _width(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def _row_width(df: DataFrame) -> Column:
    return sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most so many rows and bytes. Pass materialised rows."""
    n, total = vars(df).get("_rows_bytes") or df.agg(F.count("*"), F.sum(_row_width(df))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it none of the frame's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Sieve:
    """A Bloom filter over some keys, inside an expression, so that most other rows are told without a join.

    It is built by bitmap_construct_agg in segments of 4 KB, at most ``segments`` of them (a proven bound: they travel with the
    tasks), so with too many keys it tells fewer rows apart, but never misses a key.
    """

    BITS, PLACES = 32768, 2

    def __init__(self, keys: DataFrame, *columns: str, bits_per_key: int = 12, segments: int = 1024):
        n, _ = vars(keys).get("_rows_bytes") or (keys.count(), 0)
        self.segments = max(1, min(segments, -(-n * bits_per_key // self.BITS)))
        segment, places = self._at([F.col(c) for c in columns])
        bits = keys.select(segment.alias("segment"), F.explode(F.array(*places)).alias("bit"))
        packed = bytearray(self.segments * self.BITS // 8)
        for r in bits.groupBy("segment").agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap")).collect():  # not toLocalIterator: that runs a job for each partition
            packed[r.segment * self.BITS // 8 : (r.segment + 1) * self.BITS // 8] = r.bitmap
        self.packed = F.lit(bytes(packed))

    def _at(self, key: list[Column]) -> tuple[Column, list[Column]]:
        segment = F.pmod(F.xxhash64(F.lit(7), *key), F.lit(self.segments)).cast("long")
        return segment, [F.pmod(F.xxhash64(F.lit(100 + i), *key), F.lit(self.BITS)).cast("long") for i in range(self.PLACES)]

    def may(self, *key: Column) -> Column:
        """False only for keys that aren't there."""
        segment, places = self._at(list(key))
        found = F.lit(True)
        for place in places:
            found = found & bit_is_set(self.packed, segment * (self.BITS // 8), place)
        return found


def bit_is_set(bitmap: Column, base: Column, place: Column) -> Column:
    """Whether a bit of a binary value is set; base is in bytes, place in bits after it."""
    byte = F.conv(F.hex(F.substr(bitmap, (base + F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once for each application: they need it to run functions over Arrow batches."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not root.is_dir():
        return
    _shipped.add(context.applicationId)
    out = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(out))


def over_batches(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow, with this package on the workers.

    Batches hold at most BATCH_BYTES, or one longer row: the session's limit is lowered to that, for by default a batch of
    long texts takes 64 MB, several times over in the executor and its workers.
    """
    spark = df.sparkSession
    ship(spark)
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(_BYTES, BATCH_BYTES)
    return df.mapInArrow(run, schema)
