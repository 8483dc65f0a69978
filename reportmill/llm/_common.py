"""Shared scratch folder, table cutting and text helpers of the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which goes when the application ends. Where that is unset it is set to a temporary
    folder if all runs on one machine, as in tests; on a cluster, whose machines don't share such folders, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="reportmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/reportmill/{label}-{uuid.uuid4().hex}"
    store, place = _store(spark, path)
    store.deleteOnExit(place)
    return path


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and returns a scan of it: lineage ends there,
    so a lost executor never has an earlier stage run again."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_sweep(df: DataFrame, label: str) -> DataFrame:
    """``cut``; the shuffle files behind it go at once, as they may be as large as the texts."""
    out = cut(df, label)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def free(df: DataFrame) -> None:
    """Deletes a table that ``cut`` made, once nothing reads it any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        store, place = _store(df.sparkSession, folder)
        store.delete(place, True)


def table_files(df: DataFrame) -> list[str]:
    """The files of a table that ``cut`` made, for tasks that read it whole."""
    return sorted(df.inputFiles())


def file_count(df: DataFrame, bytes_each: int) -> int:
    """Into how many files the rows of ``df`` go: one for each ``bytes_each`` of what Spark takes its size to be, and one for each
    shuffle partition at least. So a file's size stays the same as the data grow."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = n < 1 << 60  # a plan without statistics counts as endless
    return max(part_count(df.sparkSession), -(-n // bytes_each) if known else 1)


def salted_join(rows: DataFrame, side: DataFrame, key: str, total: int, how: str = "inner", counts: DataFrame | None = None, least: int = 1000) -> DataFrame:
    """``rows`` joined to ``side`` (one row for each ``key``), where any key may hold a large share of ``rows``.

    A key with over ``limit`` rows is hot; its rows are dealt to as many salts as it has limits, and its row of ``side`` is repeated
    for each. ``limit`` is a ten-thousandth of all rows at least, so there are at most 10000 hot keys and that many repeats: the only table that is broadcast.
    ``total``: the rows of ``rows``. ``counts`` (key, n): its rows by key, counted if not given. Null keys, which meet nothing, are dealt alike.
    """
    limit = max(least, total // 10_000)
    counted = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = cut(counted.where(F.col(key).isNotNull() & (F.col("n") > limit)).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / limit).cast("int").alias("__salts")), "hot")
    others = [x for x in rows.columns if x != key] or [key]
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*others), F.lit(1 << 20))).when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*others), F.col("__salts"))).otherwise(0).cast("int")
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot", "__salts")
    held = side.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")
    return salted.join(held, [key, "__salt"], how).drop("__salt")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split() if text else []


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, never meet those an operator makes."""
    return df.select(*names)


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def modest(spark: SparkSession, rows: int = 2000) -> None:
    """Holds the session's Arrow batches to ``rows`` rows: the default suits numbers, and texts are thousands of times as long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of at most ``rows`` and about ``size`` bytes, so what a Python worker makes of a part is small, too."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[Sequence]], ddl: str, encodes: bool = False) -> DataFrame:
    """``mapInArrow`` over columns: ``work`` yields, for each batch it makes, a list of columns (Arrow arrays, numpy
    arrays or lists; None is null) in the order of ``ddl``. Batches come in small parts. Workers outlive tasks, and so do
    the chunks that a token encoder knows; work that doesn't encode frees them. Ids never pass through floats, as nullable ones in pandas do."""
    modest(df.sparkSession)
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes and (ids := sys.modules.get("reportmill.llm._ids")):
            ids.encoder.cache_clear()
        for columns in work(small(batches)):
            made = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return df.mapInArrow(run, schema)
