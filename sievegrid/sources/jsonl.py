"""JSON lines in and out, manifests and gold sets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators.dedup import first_by
from sievegrid.sources import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all lines that are JSON; a field of the wrong type is null, a missing path is an empty frame."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = lines.where(F.try_parse_json("value").isNotNull())
    return rows.select(F.from_json("value", schema).alias("row")).select("row.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last usable attempt for each document; failures are set aside first, so none hides a success."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    rows = lines.where(F.try_parse_json("value").isNotNull()).select("file", "line", F.from_json("value", schemas.FETCH).alias("row")).select("file", "line", "row.*")
    good = rows.where("status IN ('ok', 'skipped') AND local_path <> ''")
    return first_by(good, ["id"], [F.desc("file"), F.desc("line")]).drop("file", "line")


def read_gold(spark: SparkSession, path: str, limit: int = 0, need_parent: bool = True) -> DataFrame:
    """Question pairs, those without a parent set aside before the limit; 0 is no limit."""
    rows = read_jsonl(spark, path, schemas.PAIR)
    rows = rows.where("parent_id <> ''") if need_parent else rows
    return rows.orderBy("qa_id").limit(limit) if limit else rows


def catalogue(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """A source catalogue, as read from a configuration file, as a frame."""
    names = [x.split()[0] for x in schemas.SOURCE.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], schemas.SOURCE)
