"""Scans and sinks of partitioned products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("driver_id", T.StringType()), T.StructField("order_id", T.StringType()), T.StructField("timestamp", T.DoubleType()),
                       T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])


def scan_product(spark: SparkSession, root: str, columns: list[str], dates: list[str] | None = None, date: str = "date") -> DataFrame:
    """Named columns of a partitioned product, by date; partition pruning and column pruning reach the files."""
    rows = spark.read.parquet(root)
    if missing := set(columns) - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return (rows if dates is None else rows.where(F.col(date).isin(dates))).select(*columns)


def scan_points(spark: SparkSession, path: str) -> DataFrame:
    """A headerless point log; bad numbers become null (S3)."""
    return spark.read.schema(POINTS).option("mode", "PERMISSIVE").csv(path)


def scan_pois(spark: SparkSession, path: str, tokens: dict[str, list[str]]) -> DataFrame:
    """A headed CSV whose columns are found by name tokens: out name → tokens; lon and lat are coerced and bounded."""
    rows = spark.read.option("header", True).csv(path)
    found = {out: next(c for t in names for c in rows.columns if t in c.lower()) for out, names in tokens.items()}
    rows = rows.select(*[(F.col(c).try_cast("double") if out in ("lon", "lat") else F.col(c)).alias(out) for out, c in found.items()])
    return rows.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).dropDuplicates()


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """``bucket`` of a stable hash: one key never spans two buckets."""
    return rows.withColumn("bucket", F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("long"), F.lit(buckets)).cast("long"))


def publish(rows: DataFrame, root: str, partitions: list[str]) -> None:
    """Replace exactly the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(root)


def write_summary(rows: DataFrame, path: str, kind: str) -> None:
    """A small result as one JSON or headed CSV file."""
    rows.coalesce(1).write.option("header", True).format(kind).save(path)


def check_schema(rows: DataFrame, expected: T.StructType) -> None:
    """Missing, undeclared or differently typed columns are an error."""
    have, want = ({f.name: f.dataType for f in s} for s in (rows.schema, expected))
    if have != want:
        raise ValueError(f"missing {sorted(want.keys() - have.keys())}, undeclared {sorted(have.keys() - want.keys())}, "
                         f"types {sorted(c for c in have.keys() & want.keys() if have[c] != want[c])}")


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and order-insensitive digest of the columns (S9): sums of the first 13 hex digits of row hashes."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def split_role(day: Column, train: tuple[int, int], validation: tuple[int, int], test: tuple[int, int]) -> Column:
    """train, validation, test or null by day of month; the ranges must be disjoint."""
    if not train[1] < validation[0] <= validation[1] < test[0]:
        raise ValueError("splits overlap")
    return F.when(day.between(*train), "train").when(day.between(*validation), "validation").when(day.between(*test), "test")
