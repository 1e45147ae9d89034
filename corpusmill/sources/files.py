"""Folders of mixed documents to a table of texts with a parse status per file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions.text import (
    PARSED_TEXT,
    PARSER_EXTENSIONS,
    decode_text,
    pretty_json,
    suffix,
    with_html_text,
)
from corpusmill.session import hadoop_files, scratch_dir

# --- fixed values -----------------------------------------------------------------------------
TEXT_EXTENSIONS, JSON_EXTENSIONS, HTML_EXTENSIONS = ["txt", "md"], ["json"], ["html", "htm"]
# Formats whose bytes need a library; they count as unsupported until an extractor is given.
LIBRARY_EXTENSIONS = ["pdf", "docx"]
# ----------------------------------------------------------------------------------------------

Extractor = Callable[[bytes], str]
LIST_BATCH = 50_000
READ_BYTES = 16 << 20
ENTRY = "path string, millis long, length long, is_folder boolean"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def supported_extensions(extractors: dict[str, Extractor] | None = None) -> list[str]:
    """Parser formats minus those whose library is not there."""
    missing = set(LIBRARY_EXTENSIONS) - set(extractors or {})
    return [e for e in PARSER_EXTENSIONS if e not in missing]


def name_pattern(extensions: list[str]) -> str:
    """File-name pattern for a set of extensions in any letter case."""
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in extensions]
    return "*.{" + ",".join(any_case) + "}"


def list_folder(spark: SparkSession, directory: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """``(path, modificationTime, length)`` of every file with one of ``extensions``, whatever its name or size.

    Spark's own file index leaves out names that begin with ``_`` or ``.``, so this asks the file system itself.
    Folders are listed in the tasks, a level of the tree after the other, and nothing of a listing reaches the driver.
    Only where Arrow does not know the file system does the driver list, in batches of ``LIST_BATCH`` rows.
    """
    wanted = tuple("." + e.lower().lstrip(".") for e in (supported_extensions() if extensions is None else extensions))
    files, make = hadoop_files(spark, directory)
    place = make(directory)
    if not files.exists(place):
        raise FileNotFoundError(f"Directory not found: {directory}")
    root, target = files.makeQualified(place).toString().rstrip("/"), scratch_dir(spark, "listing")
    if _known_to_arrow(root) and files.getFileStatus(place).isDirectory():
        _list_levels(spark, root, target, recursive, wanted)
    else:
        _list_here(spark, files.listFiles(place, recursive), target, wanted)
    listed = spark.read.schema(f"{ENTRY}, level int").parquet(target)
    return listed.where("not is_folder").select("path", F.timestamp_millis("millis").alias("modificationTime"), "length")


def _list_here(spark: SparkSession, found, target: str, wanted: tuple[str, ...]) -> None:
    rows = []

    def write() -> None:
        spark.createDataFrame(rows, ENTRY).write.mode("append").parquet(f"{target}/level=0")

    while found.hasNext():
        status = found.next()
        path = status.getPath().toString()
        if path.rsplit("/", 1)[-1].lower().endswith(wanted):
            rows.append((path, status.getModificationTime(), status.getLen(), False))
        if len(rows) >= LIST_BATCH:
            write()
            rows = []
    write()


def _list_levels(spark: SparkSession, root: str, target: str, recursive: bool, wanted: tuple[str, ...]) -> None:
    """Entries of ``root`` as ``level=0``, those of its folders as ``level=1`` and so on; a folder is listed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, inner = open_path(folder)
                rows = []
                for info in system.get_file_info(pa_fs.FileSelector(inner, recursive=False)):
                    is_folder = info.type == pa_fs.FileType.Directory
                    if is_folder or info.base_name.lower().endswith(wanted):
                        rows.append((f"{folder}/{info.base_name}", (info.mtime_ns or 0) // 1_000_000, info.size or 0, is_folder))
                for i in range(0, len(rows), LIST_BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + LIST_BATCH])], ["path", "millis", "length", "is_folder"])

    cores = spark.sparkContext.defaultParallelism
    folders, level = spark.createDataFrame([(root,)], "path string"), 0
    while True:
        path = f"{target}/level={level}"
        folders.repartition(cores, "path").mapInArrow(run, ENTRY).write.parquet(path)
        folders, level = spark.read.schema(ENTRY).parquet(path).where("is_folder").select("path"), level + 1
        if not recursive or folders.isEmpty():
            return


def _known_to_arrow(path: str) -> bool:
    try:
        open_path(path)
        return True
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False


def open_path(path: str):
    """File system and inner path of a full path, for use inside tasks."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)", path, re.S)
    if not scheme:
        return pa_fs.LocalFileSystem(), path
    return pa_fs.FileSystem.from_uri(f"{scheme[1]}:{scheme[2] or '//'}{quote(scheme[3])}")


def read_contents(listed: DataFrame) -> DataFrame:
    """Listed files with their content, read by path in the tasks; a file that cannot be read has NULL content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, start = [], 0, 0
            for i, (path, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                content = b""
                if length:
                    try:
                        system, inner = open_path(path)
                        with system.open_input_stream(inner) as stream:
                            content = stream.read()
                    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
                        content = None
                rows.append(content)
                size += len(content or b"")
                if size > READ_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.binary())], ["path", "modificationTime", "length", "content"])
                    rows, size, start = [], 0, i + 1

    return listed.select("path", "modificationTime", "length").mapInArrow(run, FILE_SCHEMA)


def scan_files(
    spark: SparkSession, directory: str, recursive: bool = True, extensions: list[str] | None = None
) -> DataFrame:
    """Files below ``directory`` with one of ``extensions``; no rows when there are none.

    Files of other kinds are skipped while listing, so their bytes are never read.  What Spark's file index leaves
    out (names that begin with ``_`` or ``.``, and files of no bytes) is taken from the complete listing and read
    by path.  A missing folder raises ``FileNotFoundError``.
    """
    wanted = supported_extensions() if extensions is None else extensions
    if not wanted:
        return spark.createDataFrame([], FILE_SCHEMA)
    listed = list_folder(spark, directory, recursive, wanted)
    scan = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", name_pattern(wanted))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(directory)
    )
    rest = listed.join(scan.select("path"), "path", "left_anti")  # paths only; no content is read for this
    return scan.unionByName(read_contents(rest))


def file_metadata(files: DataFrame) -> DataFrame:
    """File facts without reading content; the creation time has no source and stays NULL."""
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size_bytes"),
        suffix(F.col("path")).alias("extension"),
        F.lit(None).cast("timestamp").alias("created"),
        F.col("modificationTime").alias("modified"),
    )


def _extract_udf(extractors: dict[str, Extractor]):
    arrow = to_arrow_type(PARSED_TEXT)

    @F.arrow_udf(PARSED_TEXT)
    def extract(kind: pa.Array, content: pa.Array) -> pa.Array:
        def one(extension, raw):
            if raw is None:
                return None
            try:
                text = extractors[extension](raw)
                text.encode("utf-8")
                return {"text": text, "error": None}
            except Exception as problem:  # a bad file is a failed row, not a failed job
                return {"text": None, "error": str(problem)}

        return pa.array([one(k, c) for k, c in zip(kind.to_pylist(), content.to_pylist())], arrow)

    return extract


def parse_files(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Text, success and error of every file (needs ``path`` and ``content``).

    Each format takes its own path, and only the bytes that need Python go there.  A file that
    cannot be read as its format becomes a failed row with empty text.
    """
    known = supported_extensions(extractors)
    ext = F.ltrim(suffix(F.col("path")), F.lit("."))
    content = F.col("content")
    rest = [c for c in files.columns if c != "content"]
    parsed = files.withColumn("_ext", ext)
    kind = F.col("_ext")

    def only(extensions: list[str]):
        return F.when(kind.isin(extensions), content)

    parsed = parsed.withColumns({
        "_json": pretty_json(only(JSON_EXTENSIONS)), "_plain": decode_text(only(TEXT_EXTENSIONS + HTML_EXTENSIONS)),
    })
    parsed = with_html_text(parsed.withColumn("_markup", F.when(kind.isin(HTML_EXTENSIONS), F.col("_plain"))), "_markup", "_visible")
    text = (
        F.when(kind.isin(TEXT_EXTENSIONS), F.col("_plain"))
        .when(kind.isin(JSON_EXTENSIONS), F.col("_json.text"))
        .when(kind.isin(HTML_EXTENSIONS), F.col("_visible"))
    )
    error = F.when(~kind.isin(known), F.concat(F.lit("Unsupported file format: ."), kind)).when(
        kind.isin(JSON_EXTENSIONS), F.col("_json.error")
    )
    if extractors:
        own = list(extractors)
        parsed = parsed.withColumn("_own", _extract_udf(extractors)(kind, only(own)))
        text = text.when(kind.isin(own), F.col("_own.text"))
        error = error.when(kind.isin(own), F.col("_own.error"))
    return parsed.select(*rest, text.alias("_text"), error.alias("error")).select(
        *rest,
        F.when(F.col("error").isNull(), F.coalesce("_text", F.lit(""))).otherwise("").alias("text"),
        F.col("error").isNull().alias("success"),
        "error",
    )


def with_missing(requested: DataFrame, parsed: DataFrame) -> DataFrame:
    """``parsed`` for every requested ``path``; paths that were not found become failed rows."""
    joined = requested.select("path").join(parsed.withColumn("_found", F.lit(True)), "path", "left")
    absent = F.col("_found").isNull()
    return joined.select(
        *[F.col(c) for c in parsed.columns if c not in ("text", "success", "error")],
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.when(absent, F.concat(F.lit("File not found: "), "path")).otherwise(F.col("error")).alias("error"),
    )


def parse_summary(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def direct_text(texts: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """Rows that already hold text, as documents; texts shorter than 10 characters are refused."""
    return texts.filter(F.length(F.trim(F.col(text))) >= 10).select(
        F.col(key).cast("string").alias("doc_key"), F.col(source).alias("source"),
        F.lit("direct_text").alias("type"), F.col(text).alias("text"), F.lit(True).alias("success"),
    )


def merge_metadata(base, extra):
    """Two string maps in one; the second wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return F.when(extra.isNull(), base).when(base.isNull(), extra).otherwise(F.map_concat(kept, extra))


FILES_TYPE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
