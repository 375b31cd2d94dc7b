"""What the operators share: written intermediates, tables, text features and components."""

from __future__ import annotations

import gc
import re
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.sources.shared import shared_dir

#: Rows and bytes of one Arrow batch. Texts are long, so batches are held below Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back. This cuts the lineage, and what was
    written outlives the executor that wrote it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/affinis/{name}-{uuid.uuid4().hex}"
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._affinis_path = path  # noqa: SLF001
    return back


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that no later plan reads, and let Spark free shuffles."""
    for df in tables:
        path = getattr(df, "_affinis_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


#: Bits of a filter of keys; as 64-bit words it has at most 2**20 rows, whatever the input.
FILTER_BITS = 26


def _bit(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))


def key_filter(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """(word, mask): the bits of the hashes of ``key``, in at most 2**bits / 64 rows. Written."""
    at = keys.select(_bit(key, bits).alias("bit"))
    return written(at.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")), "bits")


def marked(rows: DataFrame, key: Column, words: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with the column ``name``: false only if ``key`` is none of the keys of the filter. The
    filter is broadcast; it lets through too much where it is full, and never too little."""
    at = rows.withColumn("_bit_", _bit(key, bits)).withColumn("word", F.shiftright("_bit_", 6))
    return at.join(F.broadcast(words), "word", "left").withColumn(name, F.coalesce(F.expr("shiftright(mask, cast(_bit_ & 63 AS int)) & 1L"), F.lit(0)) == 1).drop("word", "_bit_", "mask")


def fewer_files(df: DataFrame) -> DataFrame:
    """``df`` in at most an eighth of the session's shuffle partitions, though never in fewer than four
    for each core, where files would be many and tiny."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def small_batches(spark: SparkSession) -> None:
    """Hold the batches of scans and of Arrow to sizes that suit long texts, unless the session asks
    for smaller ones. The settings stay in the session, because plans take them up when they run."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).lower().rstrip("b")
    if not (size.isdigit() and int(size) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


#: Rows of one Arrow batch of numbers, where the session does not ask for fewer.
NUMBERS = 1 << 14


@contextmanager
def numbers(spark: SparkSession):
    """Arrow batches that suit rows of a few numbers, for what is run inside."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(rows), spark.conf.get(size)
    if was == (str(BATCH_ROWS), str(BATCH_BYTES)):
        spark.conf.set(rows, str(NUMBERS))
        spark.conf.set(size, str(BATCH_BYTES // 2))
    try:
        yield
    finally:
        spark.conf.set(rows, was[0])
        spark.conf.set(size, was[1])


def held_out(doc_id: Column) -> Column:
    """The remainder 2 of crc32 of the id as text marks the rows that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows (a tenth more at most, in expectation), chosen by a hash of ``key``; all
    rows where there are fewer. One counting pass, no sort."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * rows / total))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph; component is the least node id reachable.

    Alternating large-star and small-star steps: each step hooks neighbours onto the least
    neighbour, so a chain of n links needs about log n rounds. Every round is written to the shared
    folder, and only a count and a checksum reach the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        # large star: neighbours above a node move to the least of its neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its lower neighbours move to the least of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        step = written(fewer_files(small.union(low.select("u", F.col("m").alias("v"))).distinct()), "star")
        seen = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = step
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    # settled: stars, every node points at the least of its component
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


SPACES = " \t\n\x0b\x0c\r"
LETTER = re.compile(r"[^\W\d_]")


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of ``counts``, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def mapped(df: DataFrame, text: str, keep: list[str], fields: str, make) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields`` (DDL), which ``make()`` computes from texts.

    ``make()`` is called once in each task and returns a function from a list of texts (null: None)
    to the list of new columns. A kept column that has the name of a new one gives way to it.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    new = StructType.fromDDL(fields)
    taken = {n.lower() for n in new.names}
    src = df.select(*[F.col(c) for c in keep if c.lower() not in taken], F.col(text).alias("_text_"))
    schema = StructType([*src.schema.fields[:-1], *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        work = make()
        for b in batches:
            made = work(b.column(b.num_columns - 1).to_pylist())
            columns = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=schema.names)

    return src.mapInArrow(run, schema)
