"""Incremental loads: assertions arrive file by file, votes and usage are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.text import squeeze, strip_all


def _reader(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A stream over the files of a table, which is a folder or a single file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    folder, only = (path, None) if fs.getFileStatus(p).isDirectory() else (str(p.getParent()), p.getName())
    r = spark.readStream.schema(schema).options(**options)
    return (r.option("pathGlobFilter", only) if only else r).parquet(folder)


def edge_rows(relations: DataFrame) -> DataFrame:
    return relations.where("head is not null and relation is not null and tail is not null").select(
        "book", strip_all(F.col("head")).alias("head"), strip_all(F.col("relation")).alias("relation"), strip_all(F.col("tail")).alias("tail"), F.xxhash64(squeeze(F.coalesce("evidence", F.lit("")))).alias("text")
    )


def about_votes(spark: SparkSession, source: str, schema, name: str, checkpoint: str, files_per_trigger: int = 1) -> StreamingQuery:
    """A quick look at a stream: mentions by edge and approximate votes (about 5 % off on busy edges), in a table of the driver's memory; :func:`append_votes` is exact."""
    rows = edge_rows(_reader(spark, source, schema, maxFilesPerTrigger=files_per_trigger))
    votes = rows.groupBy("book", "head", "relation", "tail").agg(F.count("*").alias("mentions"), F.approx_count_distinct("text").alias("about_votes"))
    return votes.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_usage(spark: SparkSession, source: str, schema, name: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Calls by hour and kind; an hour comes out, and its state goes, once the watermark has passed it."""
    e = _reader(spark, source, schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("calls"))
    return w.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_votes(spark: SparkSession, source: str, schema, table: str, checkpoint: str, files_per_trigger: int = 1) -> StreamingQuery:
    """Each batch's partial counts are a partition of the table, the state is the table itself, and totals are one aggregation on read.

    A batch that runs again after a failure writes its own partition anew, so that nothing counts twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        part = edge_rows(batch).groupBy("book", "head", "relation", "tail", "text").agg(F.count("*").alias("mentions"))
        part.write.mode("overwrite").parquet(f"{table}/batch={n}")

    rows = _reader(spark, source, schema, maxFilesPerTrigger=files_per_trigger)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_votes(spark: SparkSession, table: str) -> DataFrame:
    """(book, head, relation, tail, mentions, votes) of everything appended."""
    p = spark.read.parquet(table).groupBy("book", "head", "relation", "tail", "text").agg(F.sum("mentions").alias("m"))
    return p.groupBy("book", "head", "relation", "tail").agg(F.sum("m").alias("mentions"), F.count("*").alias("votes"))
