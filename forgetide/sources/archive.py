"""Hourly event archives: text lines to parsed records, with rejects kept apart.

A record's place is `seq` = (file, block, row, idx). The row number comes from the
scan itself, where lines of one block are read in order by one task, so the order
of records within a file is the same in every run and after a lost executor.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOUNDARY = r"(?<=\})(?=\s*\{)"

REPLACEMENT = "\ufffd"
STAND_IN = "\U0010ffff"  # a noncharacter


def scan_order(df: DataFrame) -> Column:
    """Place of a row in the files just read; to be taken directly above the scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def repair(value: Column | str, errors: str = "replace") -> Column:
    """Bad bytes become U+FFFD, or vanish with errors="ignore", which leaves a U+FFFD of the text alone."""
    if errors != "ignore":
        return F.make_valid_utf8(value)
    value = F.col(value) if isinstance(value, str) else value
    fixed = F.make_valid_utf8(F.replace(value, F.lit(REPLACEMENT), F.lit(STAND_IN)))
    return F.replace(F.replace(fixed, F.lit(REPLACEMENT), F.lit("")), F.lit(STAND_IN), F.lit(REPLACEMENT))


def read_lines(spark: SparkSession, path: str | list[str], errors: str = "replace") -> DataFrame:
    """Lines of text files, gzip included; a gzip file is one task."""
    raw = spark.read.text(path)
    return raw.select(repair("value", errors).alias("value"), scan_order(raw).alias("place"))


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def record_texts(line: Column | str) -> Column:
    """The JSON texts on one line. Pieces between "}" and "{" are records when each
    parses; otherwise (the boundary lies inside a string) pieces are joined until
    they parse. What never parses is the last element."""
    line = F.col(line) if isinstance(line, str) else line
    pieces = F.split(line, BOUNDARY)
    none = F.lit(None).cast("array<string>")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def join(acc, piece):
        text = F.concat(acc.open, piece)
        closed = _is_json(text)
        return F.struct(F.when(closed, F.array_append(acc.done, text)).otherwise(acc.done).alias("done"),
                        F.when(closed, F.lit("")).otherwise(text).alias("open"))

    folded = F.aggregate(pieces, start, join, lambda acc: F.when(
        F.trim(acc.open) == "", acc.done).otherwise(F.array_append(acc.done, acc.open)))
    return (F.when(F.trim(line) == "", none)
             .when(~line.rlike(r"\}\s*\{"), F.array(line))
             .when(F.forall(pieces, _is_json), pieces)
             .otherwise(folded))


def parse_records(lines: DataFrame) -> DataFrame:
    """One row per record: `v` (null when unreadable), `text`, `seq`, `error_reason`."""
    rows = lines.select("place", F.posexplode(record_texts("value")).alias("idx", "text"))
    # The row id keeps later filters above this step. Pushed below it, each mention of
    # a document value in a filter would parse the text once more.
    parse_once = F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json("text"))
    parsed = rows.select(
        F.struct("place.file", "place.block", "place.row", "idx").alias("seq"), "text",
        parse_once.alias("v"))
    reason = (F.when(F.col("v").isNull(), F.lit("not JSON"))
               .when(~F.ltrim("text").startswith("{"), F.lit("not an object")))
    return parsed.withColumn("error_reason", reason)


def accepted(records: DataFrame) -> DataFrame:
    return records.filter(F.col("error_reason").isNull())


def rejected(records: DataFrame) -> DataFrame:
    """The error sink: what could not be used, and why."""
    return records.filter(F.col("error_reason").isNotNull()).select("seq", "text", "error_reason")


def read_archive(spark: SparkSession, path: str | list[str], errors: str = "replace",
                 parts: int | None = None) -> DataFrame:
    """Records of the files. A gzip file is one task's; `parts` deals the lines out anew before they are
    parsed, for few large files on many cores."""
    lines = read_lines(spark, path, errors)
    return parse_records(lines if parts is None else lines.repartition(parts))


def land(records: DataFrame, path: str, created_at: str = "created_at") -> None:
    """Write by hour; later scans of a range open only the hours in it. Rows are dealt out by ranges of time, so a task
    writes few hours and a crowded hour is written by several tasks."""
    (records.withColumn("date", F.date_format(created_at, "yyyy-MM-dd"))
            .withColumn("hour", F.hour(created_at))
            .repartitionByRange("date", "hour", created_at)
            .write.partitionBy("date", "hour").mode("append").parquet(path))


def _moment(value) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))


def hours_between(start, end) -> list[dt.datetime]:
    """The hours of a range, both ends included, stepping whole hours from `start`."""
    first, last = _moment(start), _moment(end)
    steps = int((last - first).total_seconds() / 3600) + 1
    floor = first.replace(minute=0, second=0, microsecond=0)
    return [floor + dt.timedelta(hours=h) for h in range(max(steps, 0))]


def read_hours(spark: SparkSession, root: str, start, end, errors: str = "replace", parts: int | None = None) -> DataFrame:
    """Records of the hourly files <root>/<year>/<date>-<hour>.json.gz of a range. The years' folders are listed and
    their files chosen by name; an absent hour is simply not there, an absent root is an error."""
    hours = hours_between(start, end)
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(root)
    nothing = spark.createDataFrame([], "value string, place struct<file:string,block:bigint,row:bigint>")
    if not hours:
        return parse_records(nothing)
    years = ",".join(str(y) for y in range(hours[0].year, hours[-1].year + 1))
    name = F.col("_metadata.file_name")
    hour = F.to_timestamp(F.concat(F.substring_index(name, "-", 3), F.lit(" "), F.lpad(
        F.regexp_extract(name, r"-(\d+)\.json\.gz$", 1), 2, "0")), "yyyy-MM-dd HH")
    try:
        raw = spark.read.text(f"{root.rstrip('/')}/{{{years}}}/????-??-??-*.json.gz")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return parse_records(nothing)
    chosen = raw.filter(hour.between(F.lit(hours[0]), F.lit(hours[-1])))
    lines = chosen.select(repair("value", errors).alias("value"), scan_order(raw).alias("place"))
    return parse_records(lines if parts is None else lines.repartition(parts))


def scan_hours(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Landed records of an hour range; absent hours are simply not there."""
    hours = hours_between(start, end)
    landed = spark.read.parquet(path)
    if not hours:
        return landed.filter(F.lit(False))
    first, last = hours[0], hours[-1]
    day, hour = F.col("date").cast("date"), F.col("hour")
    after = (day > F.lit(first.date())) | ((day == F.lit(first.date())) & (hour >= first.hour))
    before = (day < F.lit(last.date())) | ((day == F.lit(last.date())) & (hour <= last.hour))
    return landed.filter(after & before)


def sample_projects(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """The project list, one owner/project per line."""
    name = F.trim("value")
    names = spark.read.text(path).select((F.lower(name) if lower else name).alias("project"))
    return names.filter("project <> ''").distinct()
