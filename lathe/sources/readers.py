"""Readers with explicit schemas: JSON lines and arrays, nested documents, ARFF, sheets, files named by key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions import lexicon as lx
from lathe.functions.metrics import class_family, class_label
from lathe.functions.text import join_hyphens, strip, tokens, word_count

DOCUMENT = "struct<pages:array<struct<content:array<struct<text:string>>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, missing_ok: bool = True) -> DataFrame:
    """A row for each line; blank lines are skipped; a missing file is an empty table if ``missing_ok``."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType, missing_ok: bool = False) -> DataFrame:
    """A row for each element of a JSON array in a file."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_files(spark: SparkSession, glob: str, schema: str | T.StructType, suffix: str, key: str = "model") -> DataFrame:
    """All files of a pattern; the key is the file name before ``suffix``."""
    own = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){suffix}$", 1)
    return spark.read.schema(schema).json(glob).withColumn(key, F.url_decode(own))


def documents(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): one JSON file each, the id its name without extension; malformed files become error rows."""
    raw = spark.read.text(glob, wholetext=True).select(F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", "").alias("document_id"), F.col("value"))
    read = raw.withColumn("doc", F.from_json("value", DOCUMENT)).withColumn("good", F.try_parse_json("value").isNotNull() & F.col("doc").isNotNull())
    return read.where("good").select("document_id", "doc.pages"), read.where("not good").select("document_id", F.lit("malformed JSON").alias("error"))


def blocks(docs: DataFrame, fewest: int = 3) -> DataFrame:
    """(document_id, page, block, text): text blocks in order, without page numbers and scraps."""
    pages = docs.select("document_id", F.posexplode("pages").alias("page", "_page"))
    found = pages.select("document_id", "page", F.posexplode("_page.content").alias("block", "_block")).withColumn("text", strip(F.coalesce("_block.text", F.lit(""))))
    kept = found.where(~F.col("text").rlike(r"^\d{1,3}$") & (F.size(tokens(F.col("text"))) >= fewest))
    return kept.select("document_id", "page", "block", join_hyphens(F.col("text")).alias("text"))


def requirement_ids(text) -> F.Column:
    """Distinct numbers of four digits below 5000 that aren't years, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(lx.REQUIREMENT_ID), 1), lambda x: x.cast("long"))))


def id_based(ids) -> F.Column:
    """Whether a document numbers its requirements: from its sorted ids and their gaps."""
    n = F.size(ids)
    gaps = F.when(n > 1, F.zip_with(F.slice(ids, F.lit(2), n - 1), F.slice(ids, F.lit(1), n - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<bigint>"))
    middle = F.get(F.array_sort(gaps), F.floor(F.size(gaps) / 2).cast("int"))
    large = F.size(F.filter(gaps, lambda g: g > 100))
    tens = F.size(F.filter(ids, lambda i: i % 10 == 0))
    return F.when((n < 3) | (large > F.size(gaps) * 0.4), False).when(tens > n * 0.5, True).otherwise((middle <= 50) & (n >= 5))


def id_segments(docs: DataFrame, text: str = "text", id_col: str = "document_id", fewest: int = 5, most: int = 80) -> DataFrame:
    """(document_id, requirement_id, requirement_text, priority, word_count): the text after each id up to the next."""
    pattern = rf"(?s){lx.REQUIREMENT_ID}(.*?)(?={lx.REQUIREMENT_ID}|$)"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), 1).alias("raw"), F.regexp_extract_all(F.col(text), F.lit(pattern), 2).alias("chunk"))
    found = docs.select(id_col, F.posexplode(pairs).alias("ordinal", "_pair")).select(id_col, "ordinal", F.col("_pair.raw").alias("req_id_raw"), strip(F.col("_pair.chunk")).alias("_chunk")).where("_chunk <> ''")
    priority = F.regexp_extract("_chunk", lx.PRIORITY, 1)
    body = strip(F.regexp_replace("_chunk", lx.PRIORITY, ""))
    body = strip(F.regexp_replace(body, lx.TITLE_FRAGMENT, ""))
    body = strip(F.regexp_replace(F.regexp_replace(body, r"^[-–—]\s*", ""), r"(?U)\s+", " "))
    out = found.withColumn("requirement_text", body).withColumn("word_count", word_count(F.col("requirement_text"))).where(F.col("word_count").between(fewest, most))
    return out.select(id_col, "ordinal", F.concat(F.col(id_col).cast("string"), F.lit("_"), "req_id_raw").alias("requirement_id"), "requirement_text", F.when(priority != "", priority.cast("int")).alias("priority"), "word_count", F.col("requirement_text").rlike("(?i)" + lx.MODAL_GATE).alias("is_requirement_like"))


def arff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of ``id,'text',CODE`` lines after @DATA, of one file or each of several; lines in another form are parted at the first and last comma."""
    files = spark.read.text(path, wholetext=True).select(F.split("value", r"\r\n|\n|\r").alias("_lines"))
    files = files.withColumn("_start", F.array_position(F.transform("_lines", lambda x: F.upper(strip(x))), "@DATA"))
    lines = files.select("_start", F.posexplode("_lines").alias("line", "raw")).withColumn("raw", strip(F.col("raw")))
    data = lines.where((F.col("_start") > 0) & (F.col("line") >= F.col("_start")) & (F.col("raw") != "") & ~F.col("raw").startswith("%") & ~F.col("raw").startswith("@"))
    return parsed_arff(data.select("line", "raw"))


def parsed_arff(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    strict, loose = r"^(\d+),'(.*)',([A-Z]+)$", r"^\s*(\d+)\s*,(.*),([^,]*)$"
    exact = F.col("raw").rlike(strict)
    part = lambda i: F.when(exact, F.regexp_extract("raw", strict, i)).otherwise(F.regexp_extract("raw", loose, i))
    read = data.withColumn("good", exact | F.col("raw").rlike(loose)).withColumn("project_id", part(1)).withColumn("requirement_text", F.when(exact, strip(part(2))).otherwise(F.regexp_replace(strip(part(2)), "^'+|'+$", ""))).withColumn("class", F.upper(strip(part(3))))
    rows = read.where("good").select("line", "project_id", "requirement_text", "class", class_label(F.col("class")).alias("class_full"), class_family(F.col("class")).alias("class_family"), word_count(F.col("requirement_text")).alias("word_count"))
    return rows, read.where("not good").select("line", "raw")


# Fixed values.
TEMPLATES = ["free", "EARS", "MASTER", "advEARS", "boilerplates (DODT)", "SPIDER"]
FIRST_ROW = 15


def sheet_name(name: str, templates: Iterable[str] = TEMPLATES) -> tuple[str, str] | None:
    """(project, template) of a sheet's name, the longest template first; None for other sheets."""
    for t in sorted(templates, key=len, reverse=True):
        if name.endswith(t) and name[: -len(t)].strip():
            return name[: -len(t)].strip(), t
    return None


CELLS = "project string, template string, row int, req_id string, text string, label string"


def workbook(spark: SparkSession, sheets: dict[str, list[tuple]] | str) -> DataFrame:
    """(project, template, row, req_id, text, label) of workbooks: a path (needs openpyxl; a zip's first workbook too) or sheets as rows of cells.

    Files are read and parsed in tasks, a file at a time; only sheets given as rows come from the driver.
    """
    if isinstance(sheets, str):

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("project", pa.string()), ("template", pa.string()), ("row", pa.int32()), ("req_id", pa.string()), ("text", pa.string()), ("label", pa.string())])
            for b in batches:
                for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                    found = list(_rows(_cells(path, content.as_py())))
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema=schema)

        df = spark.read.format("binaryFile").load(sheets).select("path", "content").mapInArrow(run, CELLS)
    else:
        df = spark.createDataFrame(list(_rows(sheets.items())), CELLS)
    return df.where((F.col("row") >= FIRST_ROW) & F.col("text").isNotNull() & ~F.col("text").startswith("=") & (F.size(tokens(F.col("text"))) >= 3))


def _rows(sheets: Iterable[tuple[str, Iterable[tuple]]]) -> Iterator[tuple]:
    for name, cells in sheets:
        if parsed := sheet_name(name):
            for i, row in enumerate(cells):
                yield (*parsed, i, *(None if c is None else str(c) for c in (*row, None, None, None)[:3]))


def _cells(path: str, content: bytes) -> Iterator[tuple[str, Iterable[tuple]]]:
    import io
    import zipfile

    import openpyxl

    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(next(n for n in z.namelist() if n.endswith(".xlsx")))
    book = openpyxl.load_workbook(io.BytesIO(content), read_only=True)
    return ((ws.title, ws.iter_rows(values_only=True)) for ws in book.worksheets)
