"""Files of a corpus: JSON lines, CSV, TSV, workbooks, manifests. Everything is read and written by
Spark's own readers and writers, so any path they know will do."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from rollbook.operators.relational import last_row

CORRUPT = "_corrupt"
#: Where a row stands in its file: rows of one split are in order, and splits by their offset.
POSITION = "_position"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _positioned(rows: DataFrame) -> DataFrame:
    return rows.withColumn(POSITION, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, position: bool = False) -> DataFrame:
    """Typed rows; blank and malformed lines are skipped, unknown keys dropped, missing ones null;
    a missing file is an empty table."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        out = spark.createDataFrame([], kind)
        return out.withColumn(POSITION, F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))) if position else out
    wide = StructType(list(kind.fields)).add(CORRUPT, StringType())
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    if position:
        rows = _positioned(rows)
    # the parsed columns are asked for too: a query of the corrupt column alone is refused
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_jsonl_strict(spark: SparkSession, path: str) -> DataFrame:
    """position, line, body (variant), error: every line that is not blank, readable or not."""
    rows = _positioned(spark.read.text(path)).where(F.trim("value") != "")
    body = F.try_parse_json("value")
    return rows.select(POSITION, F.col("value").alias("line"), body.alias("body"), F.when(body.isNull(), "not JSON").when(F.schema_of_variant(body).startswith("OBJECT"), F.lit(None)).otherwise("not an object").alias("error"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text; a byte-order mark is dropped, and so are rows whose every cell
    is blank."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    trimmed = rows.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in rows.columns))
    some = F.lit(False)
    for c in trimmed.columns:
        some = some | (F.coalesce(F.col(f"`{c}`"), F.lit("")) != "")
    return trimmed.where(some)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    bare = [re.sub(r"[\"']", "", c).strip() for c in rows.columns]
    return rows.toDF(*bare).select(*(F.trim(F.regexp_replace(F.col(f"`{c}`"), '"', "")).alias(c) for c in bare))


def located(columns: list[str], wanted: dict[str, str]) -> dict[str, str]:
    """field -> column, by the text of the header without case and spaces; a field that no column
    fits, or several, is an error."""
    plain = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
    out = {}
    for field, header in wanted.items():
        hits = [c for c in columns if plain(header) in plain(c)]
        exact = [c for c in hits if plain(c) == plain(header)]
        hits = exact or hits
        if len(hits) != 1:
            raise ValueError(f"{field}: {len(hits)} columns fit {header!r}")
        out[field] = hits[0]
    return out


#: A member of a workbook may not unpack to more than this.
CEILING = 64 << 20


def _member(book: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes, up to a ceiling whatever its header declares; no document types."""
    with book.open(name) as f:
        body = f.read(CEILING + 1)
    if len(body) > CEILING:
        raise ValueError(f"{name} unpacks to more than {CEILING} bytes")
    if b"<!DOCTYPE" in body[:4096] or b"<!ENTITY" in body:
        raise ValueError(f"{name} declares a document type")
    return body


def sheet_rows(content: bytes) -> list[dict[str, str]]:
    """The first sheet of a workbook: for each row the cells by their column letters."""
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(_member(book, "xl/sharedStrings.xml")).iter(f"{space}si")]
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ElementTree.fromstring(_member(book, sheet)).iter(f"{space}row"):
            cells = {}
            for c in row.iter(f"{space}c"):
                value = c.find(f"{space}v")
                text = "".join(t.text or "" for t in c.iter(f"{space}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else None)
                if text is not None:
                    cells[re.match(r"[A-Z]+", c.get("r"))[0]] = shared[int(text)] if c.get("t") == "s" else text
            rows.append(cells)
    return rows


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, row_no, cells (map of column letter to text), error: first sheets of .xlsx files."""
    schema = "path string, row_no int, cells map<string,string>, error string"
    arrow = pa.schema([("path", pa.string()), ("row_no", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = [(where, i, list(cells.items()), None) for i, cells in enumerate(sheet_rows(content))]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, SyntaxError) as e:
                    rows = [(where, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def write_parts(rows: DataFrame, path: str) -> None:
    """Compressed JSON parts; the commit protocol publishes them as a whole."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def write_index(rows: DataFrame, path: str, by: str) -> None:
    """One sorted text column as files in order."""
    rows.select(F.col(by).cast("string").alias("value")).sort("value").write.mode("overwrite").text(path)


def report(row: DataFrame) -> str:
    """A one-row table as JSON text."""
    return row.select(F.to_json(F.struct("*"))).first()[0]


def verify_outputs(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """files, rows, corrupt, duplicate_ids of written parts; parts in progress are ignored."""
    wide = StructType.fromDDL(schema).add(CORRUPT, StringType())
    rows = spark.read.schema(wide).option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn("_file", F.input_file_name())
    bad = F.col(CORRUPT).isNotNull()
    return rows.agg(F.count_distinct("_file").alias("files"), F.count_if(~bad).alias("rows"), F.count_if(bad).alias("corrupt"), (F.count_if(~bad & F.col(key).isNotNull()) - F.count_distinct(F.when(~bad, F.col(key)))).alias("duplicate_ids"))


def verify_manifest(spark: SparkSession, manifest: DataFrame, folder: str, path: str = "path", sha: str = "sha256", size: str = "size") -> DataFrame:
    """Every manifest row with ok, missing, sha_differs or size_differs, by the files themselves."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # the folder's own name ends its part of the path
    name = F.regexp_replace(F.col("path"), r"^.*?/" + re.escape(folder.rstrip("/").rpartition("/")[2]) + "/", "")
    found = files.select(name.alias("_name"), F.sha2("content", 256).alias("_sha"), F.col("length").alias("_size"))
    out = manifest.join(found, F.col(path) == F.col("_name"), "left")
    verdict = F.when(F.col("_name").isNull(), "missing").when(F.col(sha).isNotNull() & (F.col(sha) != F.col("_sha")), "sha_differs").when(F.col(size).isNotNull() & (F.col(size) != F.col("_size")), "size_differs").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("_name", "_sha", "_size")


def still_verifies(spark: SparkSession, manifest: DataFrame, folder: str, key: str, order: str, accepts=None) -> DataFrame:
    """The last row of each key, by `order`, whose file need not be fetched again: its status is ok,
    the file is there, it hashes as recorded (if that is recorded), and `accepts` (a predicate on the
    column `content`) holds. Columns status, local_file and sha256 are read."""
    last = last_row(manifest, [key], [order]).where("status = 'ok' AND local_file != ''")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_replace(F.col("path"), r"^.*?/" + re.escape(folder.rstrip("/").rpartition("/")[2]) + "/", "")
    sound = F.lit(True) if accepts is None else accepts(F.col("content"))
    found = files.select(name.alias("_name"), F.sha2("content", 256).alias("_sha"), sound.alias("_sound")).where("_sound")
    return last.join(found, (F.col("local_file") == F.col("_name")) & (F.coalesce(F.nullif("sha256", F.lit("")), F.col("_sha")) == F.col("_sha")), "left_semi")
