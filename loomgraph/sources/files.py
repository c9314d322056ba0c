"""Files of a run: whole texts, line-wise JSON, nested JSON objects, run catalogs, sinks that never overwrite a judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSERTION = "head string, relation string, tail string, evidence string, confidence string, pack string, chapters array<int>, round int"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_assertions(spark: SparkSession, path: str, schema: str = ASSERTION) -> DataFrame:
    """Line-wise JSON; a broken last line of an interrupted run is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of one JSON object whose members have the given type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def pending(packs: DataFrame, done: DataFrame) -> DataFrame:
    """Packs of which no assertion is there yet."""
    return packs.join(done.select("book", "pack").distinct(), ["book", "pack"], "left_anti")


def append_assertions(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("pack").json(path)


def write_judgements(df: DataFrame, path: str, judgement: str = "judgement") -> str:
    """Writes a sample for judging; where ``path`` already has judgements a new version beside it is written.  Returns the path written."""
    spark = df.sparkSession
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    n, at = 1, path
    while (p := jvm.org.apache.hadoop.fs.Path(at)).getFileSystem(conf).exists(p):
        old = spark.read.json(at)
        if judgement not in old.columns or not old.where(F.trim(judgement) != "").limit(1).count():
            break
        n += 1
        at = f"{path}.v{n}"
    df.write.mode("overwrite").json(at)
    return at


def primary_runs(runs: DataFrame) -> DataFrame:
    """One run for each book of (book, name, has_triples): a primary one (its name ends with 'full') before others; among primaries the last name, else the first."""
    full = F.endswith("name", F.lit("full"))
    w = Window.partitionBy("book").orderBy(F.desc("full"), F.when(F.col("full"), F.col("name")).desc_nulls_last(), F.col("name"))
    return runs.where("has_triples").withColumn("full", full).withColumn("k", F.row_number().over(w)).where("k = 1").select("book", "name", F.col("full").alias("is_primary"))


def run_path(root: str, name: str) -> str:
    """Path of a run; names that leave the root are refused."""
    if not name or "/" in name or "\\" in name or name.startswith("."):
        raise ValueError(f"no run name: {name!r}")
    return f"{root.rstrip('/')}/{name}"


def write_export(triples: DataFrame, registry: DataFrame, summary: DataFrame, path: str) -> None:
    """The three parts of a finished run as line-wise JSON: triples in the order of an export, registry and summary."""
    export(triples).write.mode("overwrite").json(f"{path}/triples")
    registry.orderBy("book", "canon").write.mode("overwrite").json(f"{path}/registry")
    summary.write.mode("overwrite").json(f"{path}/summary")


def export(triples: DataFrame) -> DataFrame:
    """Triples in the order of an export: most votes first, then head, relation, tail."""
    return triples.orderBy(F.desc("votes"), "book", "head", "relation", "tail")
