"""What the operators share: Arrow batches, written intermediate tables, connected components.

Intermediate tables go as Parquet to the folder that the cluster names in ``spark.checkpoint.dir``; so a lost
executor costs the re-run of its tasks and nothing that lies on its disk. A local folder is used only where that
setting is absent, as in tests on one machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to a Python worker. A batch also ends at BATCH_BYTES.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Rows of a narrow table that is broadcast at most; a longer one is joined by a shuffle.
BROADCAST = 100_000
#: Row numbers that one bitmap covers, and bytes of bitmaps that are broadcast at most; beyond that rows are found by a shuffle.
PAGE_BITS = 15
BITMAPS = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it again: (the table, its path)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlens/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for a broadcast where it has no more than BROADCAST rows (counted here if not given), else for a shuffle."""
    rows = df.limit(BROADCAST + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST else df.hint("merge")


def only_rows(df: DataFrame, wanted: DataFrame, most: int | None = None) -> tuple[DataFrame, str]:
    """Rows of ``df`` whose ``_row`` is among those of ``wanted``, with the columns of ``df``, and the path to release.

    Row numbers run on within a partition (``monotonically_increasing_id``), so a bitmap for each page of 32,768 numbers
    says which are wanted. The bitmaps are written, counted and broadcast, and ``df`` is not moved. Bitmaps of more than
    ``most`` (BITMAPS) bytes, about 268 million rows, are not broadcast; a shuffled semi-join then gives the same rows.
    """
    row = df["_row"].bitwiseAND((1 << PAGE_BITS) - 1)
    bits = wanted.select("_row", F.shiftright("_row", PAGE_BITS).alias("_page")).repartition("_page").groupBy("_page")
    bits, path = materialise(bits.agg(F.bitmap_construct_agg(F.col("_row").bitwiseAND((1 << PAGE_BITS) - 1)).alias("_bits")), "bitmaps")
    if bits.count() << (PAGE_BITS - 3) > (BITMAPS if most is None else most):
        return df.join(wanted.select("_row").hint("merge"), "_row", "left_semi").select(df.columns), path
    byte = F.substring(bits["_bits"], (F.shiftright(row, 3) + 1).cast("int"), F.lit(1))
    bit = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), row.bitwiseAND(7).cast("int")).bitwiseAND(1)
    on = F.shiftright(df["_row"], PAGE_BITS) == bits["_page"]
    return df.join(F.broadcast(bits), on).where(bit == 1).select([df[c] for c in df.columns]), path


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, start: Callable | None = None) -> DataFrame:
    """``fn`` over Arrow batches of ``df``. ``start`` makes a worker's state once per task; ``fn`` then gets (state, batch)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for b in batches:
            if b.num_rows:
                out = fn(state, b) if start else fn(b)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, list[str]]:
    """Connected components by alternating large-star and small-star steps.

    Every step is an aggregate (partial on the map side) and a join that AQE can split where a vertex has very many
    edges. Each round is written to the shared folder. Returns (node, root) for vertices with an edge, root the
    smallest vertex reachable, and the paths to release after use.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, path = materialise(e, "edges")
    stats = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while stats[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = low.select("u", F.col("m").alias("v"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step, step_path = materialise(kept.union(small).distinct(), "edges")
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark, path)
        e, path = step, step_path
        if now == stats:
            break
        stats = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), [path]
