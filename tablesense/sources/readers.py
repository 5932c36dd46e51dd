"""Readers for view exports: CSV, JSON rows, first available of several, many at once."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablesense.functions import words
from tablesense.sources.normalise import fix_columns, fix_nulls

#: Holds a record that did not parse, while it is read.
_UNREADABLE = "_unreadable"


def _filtered(df: DataFrame, filters) -> DataFrame:
    """Equality filters, left to the source's own pushdown."""
    for column, value in (filters or {}).items():
        df = df.where(F.col(f"`{column}`") == F.lit(value))
    return df


def read_csv_view(spark: SparkSession, path: str, filters=None, schema=None) -> DataFrame:
    """A CSV with a header; strings trimmed, its null markers as NULL.  Columns are
    strings unless a schema is given (number texts are coerced by `normalise`)."""
    reader = spark.read.option("header", True).option("multiLine", False)
    if schema is not None:
        reader = reader.schema(schema)
    return fix_nulls(_filtered(reader.csv(path), filters), tuple(words.CSV_NULL_MARKERS))


def read_json_rows(spark: SparkSession, path: str, schema=None, filters=None) -> DataFrame:
    """JSON lines or arrays of row objects."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return _filtered(reader.json(path), filters)


def rows_from_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A column of JSON arrays of row objects, unfolded to rows of `schema`."""
    return df.select(F.inline(F.from_json(F.col(column), f"array<struct<{schema}>>")))


def read_parquet_view(spark: SparkSession, path: str, filters=None) -> DataFrame:
    return _filtered(spark.read.parquet(path), filters)


READERS = {"csv": read_csv_view, "json": read_json_rows, "parquet": read_parquet_view}


def read_first_available(spark: SparkSession, attempts) -> DataFrame:
    """The first (strategy, path) that exists and has rows, marked in `strategy`."""
    reasons = []
    for strategy, path in attempts:
        try:
            df = READERS[strategy](spark, path)
            if not df.isEmpty():
                return df.withColumn("strategy", F.lit(strategy))
            reasons.append(f"{strategy}: no rows")
        except AnalysisException as error:
            reasons.append(f"{strategy}: {error.getCondition()}")
    raise ValueError("no source available: " + "; ".join(reasons))


def _plain_path(column):
    """A file's path with one slash after its scheme, as listings and readers differ."""
    return F.regexp_replace(column, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a path that are not empty; their content is not read."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select(
        _plain_path(F.col("path")).alias("_file"))


def _first_schema(spark: SparkSession, path: str) -> StructType:
    """The columns of the first parquet file that can be opened."""
    for row in _files(spark, path).orderBy("_file").toLocalIterator():
        try:
            return spark.read.parquet(row[0]).schema
        except (PySparkException, Py4JJavaError):
            continue
    raise ValueError(f"no file of {path} can be read")


def read_apart(spark: SparkSession, strategy: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(the rows that can be read, what cannot: file, records, error).

    A record that does not parse costs itself, and a file that cannot be opened costs
    itself: readers run permissively and pass over such files. A file without a single
    row is opened once more on its own, to tell an empty one from an unreadable one; of a
    file that breaks off later, the rows before are kept and nothing is told. Rows keep
    the file they came from in `_file`.
    """
    # A record with too few fields is told only if all fields are parsed.
    reader = spark.read.option("ignoreCorruptFiles", True).option("header", True).option(
        "columnPruning", False).option("columnNameOfCorruptRecord", _UNREADABLE)
    if strategy == "parquet":
        try:
            found = reader.parquet(path)
        except (PySparkException, Py4JJavaError):  # the file that was asked for the columns
            found = reader.schema(_first_schema(spark, path)).parquet(path)
        known = found.columns
        found = found.withColumn(_UNREADABLE, F.lit(None).cast("string"))
    else:
        sketch = {"csv": reader.csv, "json": reader.json}[strategy](path)
        fields = [f for f in sketch.schema if f.name != _UNREADABLE]
        known = [f.name for f in fields]
        if not known:
            raise ValueError(f"no record of {path} can be read")
        typed = reader.schema(StructType([*fields, StructField(_UNREADABLE, StringType())]))
        found = (typed.csv if strategy == "csv" else typed.json)(path)
    found = found.select("*", _plain_path(F.col("_metadata.file_path")).alias("_file"))
    # Text readers tell a bad record only while another column is read as well.
    broken = F.get(F.slice(F.array(_UNREADABLE, F.col(f"`{known[0]}`").cast("string")), 1, 1), F.lit(0))
    rows = found.where(broken.isNull()).drop(_UNREADABLE)
    if strategy == "csv":
        rows = fix_nulls(rows, tuple(words.CSV_NULL_MARKERS))
    bad = found.where(broken.isNotNull()).groupBy("_file").agg(
        F.count(F.lit(1)).alias("records"), F.substring(F.min(broken), 1, 200).alias("error"))
    listed = _files(spark, path)
    silent = [r[0] for r in listed.join(found.select("_file").distinct(), "_file", "left_anti").collect()]
    failed = []
    for file in silent:
        try:
            READERS[strategy](spark, file).limit(1).collect()
        except (PySparkException, Py4JJavaError) as error:
            failed.append((file, None, str(error).split("\n")[0][:200]))
    errors = spark.createDataFrame(failed, "_file string, records long, error string")
    return rows, errors.unionByName(bad).withColumnRenamed("_file", "file")


def ingest_batch(spark: SparkSession, targets) -> tuple[DataFrame | None, DataFrame]:
    """Many (source_id, strategy, path) at once: their rows in one DataFrame keyed by
    `source_id`, and a table of what could not be read: whole sources, files, records.

    No source, file or record stops the others, neither while the batch is planned nor
    while it is read.
    """
    tables, failed, apart = [], [], []
    for source_id, strategy, path in targets:
        try:
            rows, errors = read_apart(spark, strategy, path)
            tables.append(fix_columns(rows.drop("_file")).withColumn("source_id", F.lit(source_id)))
            apart.append(errors.select(
                F.lit(source_id).alias("source_id"), F.lit(strategy).alias("strategy"),
                F.col("file").alias("path"), "error", "records"))
        except (PySparkException, Py4JJavaError, KeyError, ValueError) as error:
            failed.append((source_id, strategy, path, str(error).split("\n")[0], None))
    merged = None
    for df in tables:
        merged = df if merged is None else merged.unionByName(df, allowMissingColumns=True)
    errors = spark.createDataFrame(
        failed, "source_id string, strategy string, path string, error string, records long")
    for part in apart:
        errors = errors.unionByName(part)
    return merged, errors
