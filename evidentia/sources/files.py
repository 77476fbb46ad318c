"""Files of the pipeline as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..schema import NOMENCLATURE


def articles(spark: SparkSession, path: str, glob: str = "PMC*.xml") -> DataFrame:
    """Raw articles: ``path`` and ``xml``, a file a row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("xml"))


def documents(spark: SparkSession, path: str, schema: StructType, glob: str = "PMC*.json") -> DataFrame:
    """JSON documents, one a file, in any layout."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(path)


def nomenclature(spark: SparkSession, path: str) -> DataFrame:
    """The gene nomenclature: tab-separated, with a header; only the columns that are used."""
    names = [f.name for f in NOMENCLATURE.fields]
    table = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return table.select([F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in names if c != "status" or c in table.columns])


def cached_nomenclature(spark: SparkSession, path: str, download: Callable[[], str]) -> DataFrame:
    """The nomenclature of a folder; the table's text is downloaded and written there only where it isn't yet."""
    try:
        return nomenclature(spark, path)
    except AnalysisException:
        lines = download().splitlines()  # some 15 MB
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        return nomenclature(spark, path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ids that were fetched before."""
    return spark.read.text(path).select(F.trim("value").alias("pmcid")).where("pmcid != ''").distinct()
