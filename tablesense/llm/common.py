"""Helpers the operators share: texts as bytes in Arrow batches, stored intermediate
tables, fold numbers, and hashed samples."""

import ctypes
import platform

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tablesense.session import ensure_checkpoint_dir, scratch_path

#: The characters that separate words, for use inside a Java or Python character class.
SPACES = r"\x20\x09-\x0D"


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whether Spark deletes a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, batch: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there, and a
    lost executor cannot change what a second reader sees.

    `batch` bounds the bytes of a batch that goes to Python while this table is written;
    texts in larger ones are held by both sides. The files that were shuffled for it go when
    it is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    wanted = {_CLEANUP: "true"} if batch is None else {_CLEANUP: "true", _BATCH: batch}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then the runs between the six ASCII space characters."""
    return text.lower().split()


def addressed(df: DataFrame, name: str) -> DataFrame | None:
    """The rows of Parquet files with a number for each, in the column `name`: the file's,
    and the row's within it. It is the same at every reading, so nothing has to be stored.
    None if the table is not of such rows, or holds one of them twice."""
    if "_metadata" in df.columns or not df.inputFiles():
        return None
    own, file = [F.col(f"`{x}`") for x in df.columns], f"{name}_file"
    try:
        rows = df.select(*own, F.col("_metadata.file_path").alias(file),
                         F.col("_metadata.row_index").alias(name))
    except AnalysisException:
        return None
    # One row for each file.
    files = sorted(r[0] for r in rows.select(file).distinct().collect())
    if not files:
        return None
    table = df.sparkSession.createDataFrame(pa.table({f"{name}_at": range(len(files)), file: files}))
    number = F.shiftleft(f"{name}_at", 40) + F.col(name)
    rows = rows.join(F.broadcast(table), file).select(*own, number.alias(name))
    if rows.groupBy(name).count().where("count > 1").isEmpty():
        return rows
    return None


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table with a number for each row, and the number's column: `name` with as many
    underscores before it as no other column needs. Rows that share an id, or have none, are
    told apart by it. Rows of Parquet files go by their place there; a table of other rows
    is stored."""
    while name in df.columns:
        name = "_" + name
    rows = addressed(df, name)
    if rows is None:
        rows = stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    return rows, name


def fold(key: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def give_back() -> None:
    """Return to the system what this worker no longer uses, such as an earlier job's
    broadcast; a reused worker would hold it until its end. Elsewhere than on glibc nothing
    happens."""
    pa.default_memory_pool().release_unused()
    if platform.libc_ver()[0] == "glibc":
        ctypes.CDLL(None).malloc_trim(0)


def broadcast_value(df: DataFrame, value):
    """A Python value for every task. Callers state why its size is bounded."""
    return df.sparkSession.sparkContext.broadcast(value)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{name}`") for name in names])


#: Bits of the filter that tells rows which surely lack a key from the rest.
FILTER_BITS = 1 << 24


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of `df` whose key is not in the one column of `keys`, rows whose key is).

    A filter of FILTER_BITS bits, whatever the number of keys, lets rows that surely have
    no such key stay where they are; only the others are joined, so wide rows move only if
    they must. Null keys are in no set.
    """
    name = keys.columns[0]
    keys = stored(keys.select(F.col(f"`{name}`").alias("_split_key")).where(
        "_split_key IS NOT NULL").distinct(), "keys")

    def slot(column):
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("int")

    at = slot("_split_key")
    # FILTER_BITS / 64 rows at most, which bounds the broadcast.
    words = stored(keys.groupBy(F.floor(at / 64).cast("int").alias("_split_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at % 64)).alias(
            "_split_bits")), "filter")
    place = slot(f"`{key}`")
    marked = df.join(F.broadcast(words), F.floor(place / 64).cast("int") == F.col("_split_word"),
                     "left")
    bit = F.call_function("shiftright", F.col("_split_bits"), place % 64).bitwiseAND(F.lit(1))
    doubt = F.coalesce(bit == 1, F.lit(False)) & F.col(f"`{key}`").isNotNull()
    sure = marked.where(~doubt).drop("_split_word", "_split_bits")
    rest = marked.where(doubt).drop("_split_word", "_split_bits")
    same = F.col(f"`{key}`") == F.col("_split_key")
    return (sure.unionByName(rest.join(keys, same, "left_anti")),
            rest.join(keys, same, "left_semi"))


def with_small_values(df: DataFrame, key: str, values: DataFrame, most: int, name: str) -> DataFrame:
    """The rows of `df` with a value from 0 to `most` in the column `name`; the two columns of
    `values` are the key, once each and none null, and its value. Every key of `df` has one.

    A filter of FILTER_BITS bits for each value, whatever the number of keys, tells which
    values a row may have. Where that is one, the row stays where it is; only the others are
    joined, so wide rows move only if they must.
    """
    at, value = (F.col(f"`{x}`") for x in values.columns)

    def slot(column):
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("int")

    held = F.call_function("shiftleft", F.lit(1).cast("long"), slot(at) % 64)
    # FILTER_BITS / 64 rows at most, which bounds the broadcast.
    words = stored(values.groupBy(F.floor(slot(at) / 64).cast("int").alias("_value_word")).agg(
        *[F.bit_or(F.when(value == i, held)).alias(f"_value_{i}") for i in range(most + 1)]), "filter")
    place = slot(f"`{key}`")
    marked = df.join(F.broadcast(words), F.floor(place / 64).cast("int") == F.col("_value_word"), "left")
    may = [F.coalesce(F.call_function("shiftright", F.col(f"_value_{i}"), place % 64).bitwiseAND(
        F.lit(1)) == 1, F.lit(False)) for i in range(most + 1)]
    several = sum((x.cast("int") for x in may[1:]), may[0].cast("int")) != 1
    only = F.coalesce(*[F.when(x, F.lit(i)) for i, x in enumerate(may)])
    own = [F.col(f"`{x}`") for x in df.columns]
    sure = marked.where(~several).select(*own, only.alias(name))
    rest = marked.where(several).select(*own)
    told = values.select(at.alias("_value_key"), value.cast("int").alias(name))
    return sure.unionByName(rest.join(told, F.col(f"`{key}`") == F.col("_value_key")).drop("_value_key"))


def slices(texts: list[bytes], most: int = 1 << 20):
    """(start, stop) of runs of texts of about `most` bytes, one text at least."""
    return sized_slices([len(text) for text in texts], most)


def sized_slices(sizes: list[int], most: int):
    """The same for texts of known sizes."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size + 64
    if start < len(sizes):
        yield start, len(sizes)


def hashed_sample(df: DataFrame, keys: list[str], most: int, total: int) -> DataFrame:
    """At most `most` of `total` rows, the first by the hash of their keys.

    Rows beyond twice that share of the hashes never leave their task, so what a task
    sends does not add up with the number of tasks.
    """
    span = 1 << 40
    at = F.pmod(F.xxhash64(F.lit(most), *keys), F.lit(span))
    share = min(1.0, 2.0 * most / max(1, total))
    return df.where(at < F.lit(int(share * span) if share < 1 else span)).orderBy(
        at, *keys).limit(most)
