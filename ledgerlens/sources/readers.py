"""Sources with explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "page int, allrow int, type string, inside string, _corrupt string"
QUESTION = "id long, question string"
REPORT = ("date", "full_name", "code", "short_name", "year", "kind")


def report_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """JSON-lines of reports; broken lines keep their text in ``_corrupt``. Adds the file and the report's identity parts."""
    r = spark.read.schema(LINE).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", recursive)
    x = r.json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return with_identity(x, F.regexp_replace("file", r"\.[A-Za-z]+$", ""))


def with_identity(df: DataFrame, name) -> DataFrame:
    """Splits ``date__full__code__short__YYYY年__kind`` into columns; the year as int."""
    parts = F.split(name, "__")
    for i, c in enumerate(REPORT):
        part = F.get(parts, F.lit(i))
        df = df.withColumn(c, F.regexp_extract(part, "([0-9]{4})", 1).try_cast("int") if c == "year" else part)
    return df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def names(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """A text list of file names: trimmed, with the suffix, sorted."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where(F.col("name").endswith(suffix)).orderBy("name")


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows (path, length, content), for documents that Python has to open."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def columns_of(spark: SparkSession, view: str) -> list[tuple[str, str]]:
    return spark.table(view).dtypes


def run_sql(spark: SparkSession, sql: str, **args) -> tuple[DataFrame | None, str | None]:
    """(result, None), or (None, message) for SQL that does not analyse."""
    from pyspark.errors import AnalysisException, ParseException

    try:
        return spark.sql(sql, args=args or None), None
    except (AnalysisException, ParseException) as e:
        return None, str(e).splitlines()[0]
