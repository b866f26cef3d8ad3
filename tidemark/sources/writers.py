"""Writers that later runs resume from: partitioned series and features, clusters, the manifest table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import same_key
from ..operators.joins import MOST_HOT


def write_series(df: DataFrame, path: str, key: Sequence[str] = ("video_id",), mode: str = "overwrite", file_rows: int = 1_000_000) -> str:
    """One folder a key, so a reader of one key opens its files alone. Files have ``file_rows`` rows at most; keys with more are
    dealt over as many tasks as they need, by one count before. Fewer than ``MOST_HOT`` keys can be that long, so their list is broadcast."""
    counts = df.groupBy(*key).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    least = max(file_rows, -(-(total or 0) // MOST_HOT))
    if (most or 0) <= least:
        dealt = df.repartition(*key)
    else:
        long_ones = counts.where(F.col("__n") > least).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.ceil(F.col("__n") / least).alias("__parts"))
        part = F.pmod(F.xxhash64(*df.columns), F.coalesce("__parts", F.lit(1)))
        dealt = df.join(F.broadcast(long_ones), same_key(key, "__k"), "left").withColumn("__part", part).repartition(*key, "__part").select(*df.columns)
    dealt.write.mode(mode).option("maxRecordsPerFile", least).partitionBy(*key).parquet(path)
    return path


def read_series(spark: SparkSession, path: str, **keys) -> DataFrame:
    """The rows of the keys given; folders of other keys aren't listed as input."""
    df = spark.read.parquet(path)
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects under an explicit schema; an empty table where nothing has been written yet."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def all_features(spark: SparkSession, path: str, key: str = "video_id") -> DataFrame:
    """The union of all keys' feature rows; ValueError if there are none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise ValueError(f"no feature files below {path}") from e
    if df.isEmpty():
        raise ValueError(f"no feature rows below {path}")
    return df.withColumn(key, F.col(key))


def concatenated(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``df`` and ``place``: its rows' positions when keys are laid one after another. Only the keys' sizes, one row
    a key, meet in one window; rows are numbered within their key."""
    from pyspark.sql import Window

    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    offsets = sizes.select(key, F.coalesce(F.sum("__n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__at"))
    numbered = df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.join(offsets, key).withColumn("place", F.col("__at") + F.col("__k") - 1).select(*df.columns, "place")


def as_bytes(pixels: Column) -> Column:
    """An array of numbers from 0 to 255 as one BINARY, as masks are stored."""
    return F.unhex(F.array_join(F.transform(pixels, lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("long")), 2, "0")), ""))


def label_names(pairs: DataFrame, label: str, name: str) -> DataFrame:
    """One row, ``names``: a JSON object of label to name. Labels are few (a dictionary's entries)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(label).cast("string").alias("k"), F.col(name).alias("v"))))
    return pairs.agg(F.to_json(F.map_from_entries(entries)).alias("names"))


def ensure_manifest(spark: SparkSession, name: str, path: str, columns: str) -> DataFrame:
    """The manifest table, created empty where it isn't there yet; a second call changes nothing."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'")
    return spark.table(name)
