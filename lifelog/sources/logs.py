"""Log files: listing, numbered lines, incremental load, clock offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan, running_sum
from ..staging import stage
from .extract import CLOCK_STEP_MS

# Fixed value: log file names carry the local start time.
FILE_NAME = r"DayZServer_X1_x64_(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})\.ADM$"


def file_started_at(name: Column) -> Column:
    """Local start time in a file name, null when it has none."""
    parts = [F.regexp_extract(name, FILE_NAME, i) for i in range(1, 7)]
    text = F.concat(F.concat_ws("-", *parts[:3]), F.lit(" "), F.concat_ws(":", *parts[3:]))
    return F.when(name.rlike(FILE_NAME), text).try_cast("timestamp")


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of ``.ADM`` files below ``path`` with start and modification time.

    ``server_id=N`` directories become a column.  Only metadata is read: the content column is
    pruned from the scan.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.ADM").option("recursiveFileLookup", "true").load(path)
        .select(F.col("path").alias("file"), F.col("modificationTime").alias("modified_at"), "length")
    )
    return (
        files.withColumn("name", F.element_at(F.split("file", "/"), -1))
        .withColumn("server_id", F.nullif(F.regexp_extract("file", r"server_id=(\d+)", 1), F.lit("")).cast("int"))
        .withColumn("started_at", file_started_at(F.col("name")))
    )


def oldest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("started_at").asc_nulls_first(), "file")


def read_log_lines(spark: SparkSession, path: str, isolate: bool = False) -> DataFrame:
    """Numbered, non-blank lines of every ``.ADM`` file: server_id, file, line_index, text.

    With ``isolate`` a file that vanishes or breaks while it is read is passed over, see ``sweep_logs``.

    Files stay splittable: the index is a running count over (file, block), so one very large
    file is read by many tasks.  Row ids are only compared within one block of one file, which
    one task reads in order.  Blank lines are dropped but keep their index.
    """
    reader = spark.read.option("pathGlobFilter", "*.ADM").option("recursiveFileLookup", "true")
    if isolate:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    lines = (
        reader.text(path)
        .select(
            F.col("value").alias("text"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    numbered = ordered_scan(
        lines, ["file"], ["block", "row"], F.col("block"), n=running_sum(F.lit(1).cast("long"))
    )
    name = F.element_at(F.split("file", "/"), -1)
    return numbered.where(F.col("text") != "").select(
        F.nullif(F.regexp_extract("file", r"server_id=(\d+)", 1), F.lit("")).cast("int").alias("server_id"),
        "file", (F.col("n") - 1).cast("int").alias("line_index"), "text",
        file_started_at(name).alias("started_at"),
    )


def _same_path(file: Column) -> Column:
    """Paths as one reader and another write them: any number of slashes behind the scheme."""
    return F.regexp_replace(file, "^([a-z]+):/+", "$1:/")


def broken_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(server_id, file, reason) of the files of a catalogue that ``lines`` do not give, or not as text.

    ``unreadable``: bytes but no line - the file vanished, broke or holds blanks only; ``undecodable``: some
    bytes are no UTF-8.  Empty files are fine.
    """
    told = lines.groupBy(_same_path(F.col("file")).alias("__file")).agg(
        F.count("*").alias("__lines"), F.count_if(~F.is_valid_utf8("text")).alias("__bad"))
    reason = F.when(F.col("__lines").isNull() & (F.col("length") > 0), "unreadable").when(F.col("__bad") > 0, "undecodable")
    return (
        files.join(told, _same_path(F.col("file")) == F.col("__file"), "left").withColumn("reason", reason)
        .where(F.col("reason").isNotNull()).select("server_id", "file", "reason")
    )


def sweep_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, quarantine): the lines of all sound files, and one row for each other file.

    The catalogue is written first and the lines after it, so both speak of the same files; a bad file costs
    its own lines only, whatever server it is of.
    """
    files = stage(log_files(spark, path).select("server_id", "file", "length"), "log-catalogue")
    lines = stage(read_log_lines(spark, path, isolate=True), "log-lines")
    broken = stage(broken_files(files, lines), "log-quarantine")
    bad = broken.select(_same_path(F.col("file")).alias("__file"))
    return lines.join(bad, _same_path(F.col("file")) == F.col("__file"), "left_anti"), broken


def files_to_load(files: DataFrame, cursor: DataFrame, budget: int) -> DataFrame:
    """Files the next load may read, per server: closed files oldest first up to ``budget``; the
    newest file only when no closed file is left waiting.

    ``cursor(file, last_processed_line, is_complete)``.  The file catalogue has one row per
    server boot, so ranking it per server is cheap.
    """
    w = Window.partitionBy("server_id")
    newest = F.max(F.struct(F.coalesce("started_at", F.timestamp_seconds(F.lit(0))), "file")).over(w)
    rows = files.join(cursor, "file", "left").withColumn("is_newest", newest["file"] == F.col("file"))
    rows = rows.where(F.col("is_newest") | ~F.coalesce("is_complete", F.lit(False)))
    place = F.row_number().over(
        w.orderBy(F.col("is_newest").cast("int"), F.col("started_at").asc_nulls_first(), "file")
    )
    closed = F.count_if(~F.col("is_newest")).over(w)
    rows = rows.withColumn("place", place).withColumn("closed", closed)
    allowed = F.when(F.col("is_newest"), F.col("closed") <= budget).otherwise(F.col("place") <= budget)
    return rows.where(allowed).select(
        "server_id", "file", "started_at", "is_newest",
        F.greatest(F.coalesce("last_processed_line", F.lit(0)), F.lit(0)).alias("last_processed_line"),
    )


def incremental_lines(lines: DataFrame, cursor: DataFrame) -> DataFrame:
    """Lines at or after the cursor of their file; files without a cursor are read whole."""
    seen = cursor.select("file", F.greatest("last_processed_line", F.lit(0)).alias("__from"))
    return (
        lines.join(seen, "file", "left")
        .where(F.col("line_index") >= F.coalesce("__from", F.lit(0))).drop("__from")
    )


def next_cursor(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Cursor rows after loading ``files``; a file that shrank is never read again.

    The cursor counts lines up to the last non-blank one.
    """
    counts = lines.groupBy("file").agg((F.max("line_index") + 1).alias("n"))
    return files.join(counts, "file", "left").select(
        "file",
        F.coalesce("n", "last_processed_line").cast("int").alias("last_processed_line"),
        (~F.col("is_newest")).alias("is_complete"),
    )


def clock_offsets(files: DataFrame, servers: DataFrame) -> DataFrame:
    """Clock offset per server: the smallest (modified - local start), rounded to a quarter hour.

    Files without a modification time are ignored; servers without candidates keep their last
    known offset.
    """
    drift = F.unix_millis("modified_at") - F.unix_millis("started_at")
    best = files.where(
        F.col("started_at").isNotNull() & (F.unix_millis("modified_at") > 0)
    ).groupBy("server_id").agg(F.min(drift).alias("best"))
    rounded = F.floor(F.col("best") / CLOCK_STEP_MS + 0.5) * CLOCK_STEP_MS
    return servers.select(F.col("id").alias("server_id"), "clock_offset_ms").join(
        best, "server_id", "left"
    ).select(
        "server_id",
        F.coalesce(rounded, "clock_offset_ms", F.lit(0)).cast("long").alias("clock_offset_ms"),
    )


def stream_log_lines(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """Closed log files as a stream of numbered lines, ``max_files`` per trigger.

    A log file is one server boot, so the file is the unit of work and is numbered in place.
    """
    raw = (
        spark.readStream.option("pathGlobFilter", "*.ADM").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files).text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    lines = raw.select("file", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_index", "text"))
    return lines.where(F.col("text") != "").select(
        F.nullif(F.regexp_extract("file", r"server_id=(\d+)", 1), F.lit("")).cast("int").alias("server_id"),
        "file", "line_index", "text",
        file_started_at(F.element_at(F.split("file", "/"), -1)).alias("started_at"),
    )
