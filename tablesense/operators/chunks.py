"""Tables as text chunks, chunks as tables again, and token-budgeted context."""

from pyspark.sql import DataFrame, Window, functions as F

from tablesense.functions import words
from tablesense.functions.text import short_hash, token_estimate
from tablesense.operators import aggregate, ordered
from tablesense.operators.roles import TableRoles

_COLUMNS = ("source_id", "source_name", "chunk_id", "chunk_type", "content", "token_count",
            "metadata")


def _single(df: DataFrame, chunk_type: str, source_id: str, source_name: str) -> DataFrame:
    return df.select(
        F.lit(source_id).alias("source_id"), F.lit(source_name).alias("source_name"),
        short_hash(F.col("content")).alias("chunk_id"), F.lit(chunk_type).alias("chunk_type"),
        "content", token_estimate(F.col("content")).alias("token_count"),
        F.lit("{}").alias("metadata"))


def schema_chunk(profile: DataFrame, source_id: str, source_name: str) -> DataFrame:
    line = F.concat(
        F.lit("  "), "column", F.lit(": "), "dtype", F.lit(" | "),
        F.col("n_unique").cast("string"), F.lit(" unique values | Sample: ["),
        F.array_join(F.slice("samples", 1, 3), ", "), F.lit("]"))
    lines = F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).line
    text = profile.agg(F.concat(
        F.lit("=== DATA SCHEMA ===\n"), F.array_join(lines, "\n"), F.lit("\nTotal: "),
        F.max("n_rows").cast("string"), F.lit(" rows × "),
        F.count(F.lit(1)).cast("string"), F.lit(" columns")).alias("content"))
    return _single(text, "schema", source_id, source_name)


def stats_chunk(df: DataFrame, roles: TableRoles, source_id: str, source_name: str) -> DataFrame:
    """Statistics of numeric columns and the top values of text columns."""
    numeric = [r["column"] for r in roles.rows if r["is_numeric"]]
    texts = [r["column"] for r in roles.rows if r["is_text"]]
    parts = [F.lit("=== STATISTICAL SUMMARY ===")]
    gather = lambda d, key, line: d.agg(F.array_join(F.sort_array(
        F.collect_list(F.struct(*key, line.alias("line")))).line, "\n").alias("t")).scalar()
    if numeric:
        stats = aggregate.describe(df, numeric)
        line = F.concat_ws("  ", "column", *[
            F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
            for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")])
        parts.append(gather(stats, ["column"], line))
    if texts:
        top = aggregate.top_values(df, texts)
        line = F.concat(F.lit("  "), "column", F.lit(" "), "value", F.lit(": "),
                        F.col("count").cast("string"), F.lit(" ("),
                        F.col("pct").cast("string"), F.lit("%)"))
        parts.append(gather(top, ["column", "rank"], line))
    row = df.sparkSession.range(1).select(F.concat_ws("\n", *parts).alias("content"))
    return _single(row, "stats", source_id, source_name)


def percent_ranges(profile: DataFrame) -> DataFrame:
    """Range lines of numeric columns whose name says percentage."""
    low = F.lower("column")
    hit = F.lit(False)
    for w in words.PERCENT_NAME_WORDS:
        hit = hit | low.contains(w)
    return profile.where(F.col("is_numeric") & hit).select(
        "source_id", "column",
        F.format_string("  %s: range %.2f%% – %.2f%%", F.col("column"), F.col("min") * 100,
                        F.col("max") * 100).alias("line"))


def summary_chunk(profile: DataFrame, source_id: str, source_name: str) -> DataFrame:
    listed = lambda cond: F.sort_array(F.collect_list(
        F.when(cond, F.struct("position", "column")))).column
    low = F.lower("column")
    dated = F.lit(False)
    for w in words.PERIOD_NAME_WORDS:
        dated = dated | low.contains(w)
    names = profile.agg(
        F.max("n_rows").alias("n"), F.count(F.lit(1)).alias("c"),
        listed(F.col("is_numeric")).alias("num"), listed(F.col("is_text")).alias("cat"),
        listed(dated).alias("dates"))
    ranges = percent_ranges(profile).agg(
        F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("t")).scalar()
    shown = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("none")
    content = F.concat_ws(
        "\n", F.lit(f"=== LIVE DATA SUMMARY: {source_name} ==="),
        F.concat(F.lit(f"Source: {source_id} | Rows: "), F.col("n").cast("string"),
                 F.lit(" | Columns: "), F.col("c").cast("string")),
        F.concat(F.lit("Numeric fields: "), shown("num")),
        F.concat(F.lit("Categorical fields: "), shown("cat")),
        F.when(F.length(ranges) > 0, ranges),
        F.when(F.size("dates") > 0, F.concat(
            F.lit("Date/period columns detected: "), F.array_join("dates", ", "))))
    return _single(names.select(content.alias("content")), "summary", source_id, source_name)


def row_chunks(df: DataFrame, order_by, source_id=None, source_name=None, source_column=None,
               rows_per_chunk=words.ROWS_PER_CHUNK) -> DataFrame:
    batches = ordered.row_batches(df, order_by, source_id, rows_per_chunk, source_column)
    name = F.lit(source_name) if source_name else F.col("source_id")
    return batches.withColumn("source_name", name).withColumn(
        "chunk_type", F.lit("rows")).withColumn(
        "metadata", F.to_json(F.struct("row_start", "row_end", "total"))).select(*_COLUMNS)


def table_chunks(df: DataFrame, profile: DataFrame, roles: TableRoles, order_by,
                 source_id: str, source_name: str,
                 rows_per_chunk=words.ROWS_PER_CHUNK) -> DataFrame:
    """Summary, schema, statistics and row chunks of one table."""
    return (
        summary_chunk(profile, source_id, source_name)
        .unionByName(schema_chunk(profile, source_id, source_name))
        .unionByName(stats_chunk(df, roles, source_id, source_name))
        .unionByName(row_chunks(df, order_by, source_id, source_name,
                                rows_per_chunk=rows_per_chunk)))


def rows_from_chunks(chunks: DataFrame, schema) -> DataFrame:
    """Row chunks back to rows, each chunk on its own, so nothing is gathered.

    The first line is the banner, the second the header, and the last line break ends
    the last row; every line between is a row, whatever it holds.
    """
    lines = F.split("content", "\n")
    rows = chunks.where(F.col("chunk_type") == "rows").select(
        "source_id", F.explode(F.slice(lines, F.lit(3), F.size(lines) - 3)).alias("_line"))
    parsed = rows.select(
        "source_id", F.from_csv("_line", schema, ordered.CSV_LINES).alias("_row"))
    texts = {f.name for f in parsed.schema["_row"].dataType if f.dataType.simpleString() == "string"}
    cell = lambda c: ordered.many_lines(F.col(f"_row.`{c}`")) if c in texts else F.col(f"_row.`{c}`")
    return parsed.select(
        "source_id", *[cell(f.name).alias(f.name) for f in parsed.schema["_row"].dataType])


def budgeted_context(chunks: DataFrame, max_tokens=words.CONTEXT_TOKENS,
                     order_col="chunk_id") -> DataFrame:
    """One context text per source within a token budget.

    Summary, stats, schema, rows, each in `order_col` order: a chunk is taken if it
    fits what is left; the first rows chunk that does not is cut by line and ends the
    text.  The greedy walk runs over identifiers only, and only over chunks it could
    take: of one type and size t at most budget / t, since what is left never grows.
    """
    priority = F.array_position(
        F.array(*[F.lit(t) for t in ("summary", "stats", "schema", "rows")]), F.col("chunk_type"))
    heads = chunks.select("source_id", "chunk_id", F.col(order_col).alias("_order"),
                          "chunk_type", F.col("token_count").cast("long").alias("t"),
                          priority.alias("p")).where(F.col("p") > 0)
    is_rows = F.col("chunk_type") == "rows"
    same_size = Window.partitionBy("source_id", "p", "t").orderBy("_order", "chunk_id")
    sized = heads.where(~is_rows & (F.col("t") <= max_tokens)).withColumn(
        "k", F.row_number().over(same_size)).where(F.col("k") <= max_tokens + 1).where(
        F.col("k") * F.greatest("t", F.lit(1)) <= max_tokens)
    # every rows chunk has a banner, hence at least one token: the first budget + 1
    # rows chunks contain the one that ends the walk
    in_order = Window.partitionBy("source_id").orderBy("_order", "chunk_id")
    first_rows = heads.where(is_rows).withColumn("k", F.row_number().over(in_order)).where(
        F.col("k") <= max_tokens + 1)
    walk = sized.unionByName(first_rows).groupBy("source_id").agg(F.sort_array(F.collect_list(
        F.struct("p", "_order", "chunk_id", "t"))).alias("steps"))
    start = F.struct(
        F.lit(max_tokens).cast("long").alias("left"), F.lit(False).alias("done"),
        F.array().cast("array<struct<n:int,chunk_id:string,room:bigint>>").alias("taken"))

    def take(acc, step):
        fits = step["t"] <= acc["left"]
        ends = (step["p"] == 4) & ~fits
        entry = F.struct(
            F.size(acc["taken"]).alias("n"), step["chunk_id"].alias("chunk_id"),
            F.when(ends, acc["left"]).otherwise(F.lit(-1)).cast("long").alias("room"))
        return F.when(acc["done"] | (~fits & ~ends), acc).otherwise(F.struct(
            F.when(fits, acc["left"] - step["t"]).otherwise(F.lit(0)).cast("long").alias("left"),
            ends.alias("done"),
            F.concat(acc["taken"], F.array(entry)).alias("taken")))

    chosen = walk.select("source_id", F.inline(F.aggregate("steps", start, take)["taken"]))
    with_text = chosen.join(
        chunks.select("source_id", "chunk_id", "content"), ["source_id", "chunk_id"])
    # lines that fit the room left in the chunk that ends the walk
    lines = F.split("content", "\n")
    cost = lambda line: F.floor((F.length(line) + 1) / 4).cast("long")
    cut = F.aggregate(
        lines, F.struct(F.col("room").alias("left"), F.lit(False).alias("done"),
                        F.array().cast("array<string>").alias("kept")),
        lambda a, x: F.when(a["done"], a).when(
            cost(x) <= a["left"], F.struct(
                (a["left"] - cost(x)).alias("left"), F.lit(False).alias("done"),
                F.concat(a["kept"], F.array(x)).alias("kept"))
        ).otherwise(F.struct(a["left"].alias("left"), F.lit(True).alias("done"),
                             a["kept"].alias("kept"))))["kept"]
    text = F.when(F.col("room") < 0, F.col("content")).when(
        F.size(cut) > 0,
        F.concat(F.array_join(cut, "\n"), F.lit("\n[...truncated to fit token budget]")))
    return with_text.withColumn("_text", text).where(F.col("_text").isNotNull()).groupBy(
        "source_id"
    ).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.array_join(F.sort_array(F.collect_list(F.struct("n", "_text")))._text, "\n\n")
        .alias("context"))
