"""Event tables kept up to date while hourly files arrive.

Each micro-batch writes its rows under its own batch number, replacing what a failed
attempt left there, so a restart repeats no rows. The table is read as the last write
per key over all batches, which is the batch job's rule.

Names learned under a known repository id count for the whole archive. Events that no name admits yet wait in
buckets by the hash of their project's name, with only the columns that the table needs. A batch adds its own, and opens the
buckets of the names that it is the first to learn; as long as it learns none it reads nothing that came before it but the list of
names. Waiting folders of one size are put together as they grow in number, and events whose names came in earlier batches are
dropped on the way, so a waiting event is rewritten a few times only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from forgetide.operators import routing
from forgetide.operators.normalize import all_aliases, by_id, learned_names, normalise, usable
from forgetide.sources.archive import accepted, parse_records, repair
from forgetide.sources.keyed import BUCKETS, BucketStore
from forgetide.sources.store import keep_last

WAITING_NAME = "_name"


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of the text files that appear in a folder."""
    reader = spark.readStream.format("text")
    raw = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(folder)
    return raw.select(repair("value").alias("value"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"))


def stream_event_table(lines: DataFrame, name: str, canon: DataFrame, target: str, progress: str,
                       buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Start feeding one event table. `progress` is the folder of the stream's own state; names and waiting
    events are beside it, the latter in `buckets`."""
    spark, state, kind = lines.sparkSession, f"{progress.rstrip('/')}-state", routing.TABLES[name][0]

    def write(batch: DataFrame, number: int) -> None:
        place = F.struct("file", "block", F.monotonically_increasing_id().alias("row"))
        # a compressed file is one task's, so the lines are dealt out anew before they are parsed
        dealt = batch.select("value", place.alias("place")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        parsed = normalise(accepted(parse_records(dealt)).drop("text"))
        parsed.write.mode("overwrite").parquet(f"{state}/events")  # read several times below
        events = spark.read.parquet(f"{state}/events")
        learned = BucketStore.open(spark, f"{state}/names", StructType.fromDDL("name string, batch int"), ["name"], 1)
        before = all_aliases(canon).union(learned.read().filter(F.col("batch") < number).select("name")).distinct()
        fresh = learned_names(usable(events), canon).join(before, "name", "left_anti")
        learned.append(fresh.withColumn("batch", F.lit(number)), token=str(number))
        new = learned.read().filter(F.col("batch") == number).select("name")
        names = before.union(new)
        foreign = usable(events).filter(F.col("event_type") == kind).join(names, F.lower("project") == F.col("name"), "left_anti")
        foreign = by_id(foreign, canon, "left_anti").drop("v").withColumns({WAITING_NAME: F.lower("project"), "batch": F.lit(number)})
        waiting = BucketStore.open(spark, f"{state}/waiting", foreign.schema, [WAITING_NAME], buckets)
        late = waiting.rows_of(new.withColumnRenamed("name", WAITING_NAME)).filter(F.col("batch") < number).drop(WAITING_NAME, "batch")
        rows = routing.chosen(events, canon, names).unionByName(routing.chosen(late, canon, names), allowMissingColumns=True)
        routing.typed_table(rows, name, keep_order=True).write.mode("overwrite").parquet(f"{target}/batch={number}")
        waiting.append(foreign, token=str(number))
        # names of earlier batches have admitted what they could; this batch may be repeated and needs its own
        known = before.withColumnRenamed("name", WAITING_NAME)
        for held in (learned, waiting):  # nobody else reads them
            if held.compact_all(None if held is learned else lambda rows: rows.join(known, WAITING_NAME, "left_anti")):
                held.vacuum()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    return (writer.trigger(**trigger) if trigger else writer).start()


def current_rows(spark: SparkSession, name: str, target: str) -> DataFrame:
    """The table as of now."""
    rows = spark.read.parquet(target)
    key = routing.TABLES[name][2]
    newest = keep_last(rows, key, ["seq", "_page", "batch"]) if key else rows
    return newest.drop("seq", "_page", "batch")
