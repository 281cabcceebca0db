"""What the corpus operators share: reading the documents, Arrow batches of bounded size, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are worked on at once. Spark's batches are larger (by its own settings, of records and bytes, which stay as they are).
BATCH_ROWS = 400


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, whatever they are called, stay out of the plan. A null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; in local mode (tests) a folder of this machine where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lathe-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lathe-{name}-{uuid.uuid4().hex}"
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key.replace("_", "."), value)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` on slices of so many rows: the bound goes along with the plan, whatever the session's settings are when it runs."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, rows):
                yield b.slice(k, rows)
            del b
            released()

    owner = getattr(work, "__module__", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn(owner)
        yield from work(sliced(batches))
        released()

    return df.mapInArrow(run, schema)


#: What empties the memories of operators, by module; whose work this worker did last.
forgetting: dict[str, Callable[[], None]] = {}
_last = ""


def turn(owner: str) -> None:
    """Before another operator's work begins in a worker, what the others remember there goes: an operator's tasks come one after another."""
    global _last
    if owner != _last:
        for module, forget in forgetting.items():
            if module != owner:
                forget()
        _last = owner
        gc.collect()
        released()


def released() -> None:
    """Gives back to the system what a worker has freed: workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def passing(docs: DataFrame, work: Callable[[list[str]], list[list]], text_col: str, added: list[tuple[str, pa.DataType, T.DataType]]) -> DataFrame:
    """``docs`` with all its columns and ``added`` after them, computed batch by batch from the texts."""
    names = [n for n, _, _ in added]
    clash = set(names) & set(docs.columns)
    if clash:
        raise ValueError(f"columns of these names are there already: {sorted(clash)}")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, _, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = work([x or "" for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, t) for v, (_, t, _) in zip(found, added, strict=True))], names=[*b.schema.names, *names])

    return in_batches(docs, run, schema)


def prefix_sums(df: DataFrame, key: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all rows with a smaller ``key`` (unique), without gathering all rows in a task.

    Rows fall into ranges of the key; each range is summed by itself, and only one row for each range meets the others.
    """
    from pyspark.sql import Window

    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return df.withColumn(out, F.lit(0).cast("long"))
    step = max(1, -(-(high - low + 1) // max(1, -(-n // width))))
    cut = df.withColumn("_range", F.floor((F.col(key) - F.lit(low)) / F.lit(step)).cast("long"))
    before = cut.groupBy("_range").agg(F.sum(value).alias("_all"))
    before = before.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy("_range").orderBy(key)) - F.col(value)
    return cut.withColumn("_inner", inner).join(before, "_range").withColumn(out, (F.col("_inner") + F.col("_before")).cast("long")).drop("_range", "_inner", "_before")
