"""Results in the shapes that clients of a metrics server expect, one row a series, and what a table of blocks holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(vector: DataFrame) -> DataFrame:
    """(metric, values): the labels of each series and its (seconds, value as text) in order of time."""
    point = F.struct("step_ts", "value")
    per = vector.groupBy("lkey").agg(F.array_sort(F.collect_list(point)).alias("p"))  # the steps of one series
    values = F.transform("p", lambda x: F.struct((x["step_ts"] / 1e9).alias("t"), _text(x["value"]).alias("v")))
    return per.select(F.from_json("lkey", "map<string,string>").alias("metric"), values.alias("values"))


def _text(x):
    inf = float("inf")
    return F.when(F.isnan(x), "NaN").when(x == inf, "+Inf").when(x == -inf, "-Inf").otherwise(x.cast("string"))


def envelope_lines(vector: DataFrame) -> DataFrame:
    """One JSON text a series: {"metric": labels, "values": [[seconds, "value"], ...]}."""
    m = matrix(vector)
    pair = lambda x: F.concat(F.lit("["), x["t"].cast("decimal(20,3)").cast("string"), F.lit(',"'), x["v"], F.lit('"]'))
    values = F.array_join(F.transform("values", pair), ",")
    return m.select(F.concat(F.lit('{"metric":'), F.to_json("metric"), F.lit(',"values":['), values, F.lit("]}")).alias("value"))


def simple_json(vector: DataFrame) -> DataFrame:
    """(target, datapoints): the labels' text and (value, milliseconds) of each series in order of time."""
    per = vector.groupBy("lkey").agg(F.array_sort(F.collect_list(F.struct("step_ts", "value"))).alias("p"))
    points = F.transform("p", lambda x: F.struct(x["value"].alias("value"), F.floor(x["step_ts"] / 1_000_000).alias("ms")))
    return per.select(F.col("lkey").alias("target"), points.alias("datapoints"))


def storage(spark: SparkSession, path: str) -> DataFrame:
    """(day, files, rows, bytes) of a table of blocks, the bytes from the file system."""
    df = spark.read.parquet(path).select("day", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    per = df.groupBy("day", "file").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("bytes"))
    return per.groupBy("day").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def registered(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table of blocks under a name of the catalog, with the days that its folder has now: those added are adopted, those
    deleted are dropped."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` USING parquet LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE `{name}` SYNC PARTITIONS")
    return spark.table(name)
