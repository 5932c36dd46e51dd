"""Access to the driver tables, and the registry of queries and their SQL."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

QUERIES = {}
SQL = {}


class Tables:
    """The tables of one scale-factor folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of `Tables` under its name, with the equivalent SQL."""

    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- tables derived from the driver tables, and the same in SQL -------------------------

PRICED_SQL = """
SELECT o.*, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS price_threshold
FROM orders o"""


def priced_orders(t: Tables) -> DataFrame:
    """Orders with the average price of their priority as a threshold."""
    orders = t["orders"]
    means = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("price_threshold"))
    return orders.join(means, "o_orderpriority").select(*orders.columns, "price_threshold")


MONTHLY_SQL = """
SELECT *, lag(current_value) OVER (PARTITION BY kri_name ORDER BY report_month)
            AS previous_value,
       CASE WHEN current_value < red_threshold THEN 'Red'
            WHEN current_value < red_threshold * 1.05 THEN 'Amber' ELSE 'Green' END
            AS rag_status
FROM (SELECT o_orderpriority AS kri_name, date_trunc('month', o_orderdate) AS report_month,
             round(avg(o_totalprice), 2) AS current_value, 280000.0 AS red_threshold
      FROM orders GROUP BY ALL)"""


def monthly_kpis(t: Tables) -> DataFrame:
    """Mean order price per priority and month against a fixed threshold, with the
    previous month and a status; windows run over the grouped months only."""
    months = t["orders"].groupBy(
        F.col("o_orderpriority").alias("kri_name"),
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("report_month"),
    ).agg(F.round(F.avg("o_totalprice"), 2).alias("current_value"))
    by_month = Window.partitionBy("kri_name").orderBy("report_month")
    value = F.col("current_value")
    return months.select(
        "kri_name", "report_month", "current_value",
        F.lit(280000.0).alias("red_threshold"),
        F.lag("current_value").over(by_month).alias("previous_value"),
        F.when(value < 280000.0, "Red").when(value < 280000.0 * 1.05, "Amber")
        .otherwise("Green").alias("rag_status"))


LABELLED_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def labelled_documents(t: Tables) -> DataFrame:
    """Document facts with their labels, NULL where a document has none."""
    return t["documents"].select("doc_id", "lang", "source", "n_chars").join(
        t["labels"], "doc_id", "left")
