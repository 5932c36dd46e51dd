"""Readers, normalisation, chunk store and exports over whole tables.

Round trips write next to the checkpoints, in a folder of their own.
"""

from pyspark.sql import functions as F

from catalogue.tables import query
from tablesense.operators import chunks as chunk_ops, ordered
from tablesense.plans.onboard import onboard, portable_document
from tablesense.session import scratch_path
from tablesense.sources import chunkstore, export, normalise, readers

_STAMP = "timestamp'2026-01-01 00:00:00'"


def _at(hours):
    return F.expr(f"{_STAMP} + make_dt_interval(0, {hours})")


def _write_csv(t, name):
    path = scratch_path(t.spark, f"{name}-csv")
    t[name].write.option("header", True).csv(path)
    return path


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_view(t):
    raw = readers.read_csv_view(t.spark, _write_csv(t, "customer"))
    table = normalise.normalise(raw)
    return table.withColumns({c: F.col(c).cast("long") for c in ("c_custkey", "c_nationkey")})


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer
          WHERE c_mktsegment = 'BUILDING'""")
def csv_view_with_filter(t):
    view = readers.read_csv_view(t.spark, _write_csv(t, "customer"), {"c_mktsegment": "BUILDING"})
    return view.select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_rows(t):
    path = scratch_path(t.spark, "supplier-json")
    t["supplier"].write.json(path)
    return readers.read_json_rows(
        t.spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("""SELECT event_type, count(*) AS n, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS total
          FROM events GROUP BY 1""")
def rows_from_json_texts(t):
    texts = t["events"].select(F.concat(
        F.lit('[{"event_type":"'), "event_type", F.lit('",'),
        F.expr("substring(props, 2)"), F.lit("]")).alias("rows"))
    rows = readers.rows_from_json_column(texts, "rows", "event_type:string,k:bigint")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("SELECT 'json' AS strategy, count(*) AS n FROM supplier")
def first_available_source(t):
    path = scratch_path(t.spark, "supplier-json")
    t["supplier"].write.json(path)
    missing = scratch_path(t.spark, "absent")
    found = readers.read_first_available(t.spark, [("csv", missing), ("json", path)])
    return found.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'customer' AS source_id, count(*) AS n, count(c_name) AS named FROM customer
          UNION ALL SELECT 'part', count(*), 0 FROM part
          UNION ALL SELECT 'missing', 0, 0""")
def ingested_batch(t):
    targets = [("customer", "parquet", f"{t.folder}/customer.parquet"),
               ("part", "parquet", f"{t.folder}/part.parquet"),
               ("missing", "parquet", f"{t.folder}/missing.parquet")]
    merged, errors = readers.ingest_batch(t.spark, targets)
    counts = merged.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("c_name").alias("named"))
    zero = F.lit(0).cast("long")
    return counts.unionByName(errors.select("source_id", zero.alias("n"), zero.alias("named")))


@query("""SELECT o_orderkey AS "Order", o_custkey AS "Order_1", o_orderstatus AS "Order Status"
          FROM orders""")
def fixed_column_names(t):
    raw = t["orders"].select(
        F.col("o_orderkey").alias(" Order "), F.col("o_custkey").alias("Order"),
        F.col("o_orderstatus").alias("Order  Status"))
    return normalise.fix_columns(raw)


@query("""SELECT o_orderstatus, count(*) AS n,
                 count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS specified,
                 count(*) FILTER (o_orderstatus = 'F') AS kept FROM orders GROUP BY 1""")
def fixed_nulls(t):
    marked = t["orders"].select(
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " N/A ")
        .otherwise(F.concat(F.lit("  "), "o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "done").when(
            F.col("o_orderstatus") == "O", "(blank)").otherwise("%null%").alias("note"))
    return normalise.fix_nulls(marked).groupBy(F.col("status").alias("o_orderstatus")).agg(
        F.count(F.lit(1)).alias("n"), F.count("priority").alias("specified"),
        F.count("note").alias("kept"))


@query("""SELECT role, count(*) AS n, count(*) FILTER (role <> 'system') AS kept
          FROM conversations GROUP BY 1""")
def cleaned_strings(t):
    marked = t["conversations"].select(
        "role", F.when(F.col("role") == "system", " nan ").otherwise(F.col("text")).alias("text"))
    return normalise.clean_strings(marked).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count("text").alias("kept"))


def _texts(t):
    return t["lineitem"].select(
        "l_returnflag", F.format_string("%,.2f", "l_extendedprice").alias("price"),
        F.format_string("%.0f%%", F.col("l_discount") * 100).alias("discount"),
        F.when(F.col("l_linestatus") == "F", "12").otherwise("open").alias("mixed"))


@query("""SELECT 'l_returnflag' AS "column", 0.0::DOUBLE AS share
          UNION ALL SELECT 'price', 1.0 UNION ALL SELECT 'discount', 1.0
          UNION ALL SELECT 'mixed', round(avg((l_linestatus = 'F')::INT), 6) FROM lineitem""")
def numeric_text_shares(t):
    return normalise.numeric_text_shares(_texts(t)).withColumn("share", F.round("share", 6))


@query("""SELECT l_returnflag, round(sum(round(l_extendedprice, 2)), 2) AS price,
                 round(sum(round(l_discount * 100, 0)), 2) AS discount, min(
                   CASE WHEN l_linestatus = 'F' THEN '12' ELSE 'open' END) AS mixed
          FROM lineitem GROUP BY 1""")
def coerced_numbers(t):
    table = normalise.coerce_numeric(_texts(t))
    return table.groupBy("l_returnflag").agg(
        F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("discount"), 2).alias("discount"),
        F.min("mixed").alias("mixed"))


@query("""SELECT o_orderkey, o_custkey::DOUBLE AS "Customer", o_totalprice AS "Price"
          FROM orders""")
def pivoted_measures(t):
    cells = F.array(
        F.struct(F.lit("Price").alias("Measure Names"),
                 F.col("o_totalprice").alias("Measure Values")),
        F.struct(F.lit("Customer").alias("Measure Names"),
                 F.col("o_custkey").cast("double").alias("Measure Values")))
    return normalise.pivot_measure_names(t["orders"].select("o_orderkey", F.inline(cells)))


@query("""SELECT max(o_totalprice) FILTER (o_orderstatus = 'F') AS "F",
                 max(o_totalprice) FILTER (o_orderstatus = 'O') AS "O",
                 max(o_totalprice) FILTER (o_orderstatus = 'P') AS "P"
          FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k
                FROM orders) GROUP BY k""")
def pivoted_measures_by_row(t):
    long = t["orders"].select(
        F.col("o_orderstatus").alias("Measure Names"),
        F.col("o_totalprice").alias("Measure Values"), "o_orderkey")
    return normalise.pivot_measure_names(long, order_by=["o_orderkey"])


@query("SELECT doc_id, quality FROM labels")
def without_empty_parts(t):
    labels = t["documents"].join(t["labels"], "doc_id", "left").select(
        F.when(F.col("quality").isNotNull(), F.col("doc_id")).alias("doc_id"), "quality",
        F.lit(None).cast("string").alias("note"))
    return normalise.drop_empty_columns(normalise.drop_empty_rows(labels))


# --- chunks and their store -------------------------------------------------------------

_ORDER_LINE = "o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',' || o_orderpriority"


def _order_rows(t):
    return t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
           n AS (SELECT count(*) AS total FROM orders),
           b AS (SELECT i // 50 AS batch_no, min(i) AS row_start, max(i) + 1 AS row_end,
                        any_value(total) AS total,
                        string_agg({_ORDER_LINE}, chr(10) ORDER BY i) AS body
                 FROM r, n GROUP BY 1),
           c AS (SELECT *, '=== DATA ROWS ' || (row_start + 1) || '–' || row_end || ' of ' || total
                        || ' ===' || chr(10)
                        || 'o_orderkey,o_custkey,o_orderstatus,o_orderpriority' || chr(10)
                        || body || chr(10) AS content FROM b)
           SELECT batch_no, row_start, row_end, total, substring(md5(content), 1, 12) AS chunk_id,
                  (length(content) // 4)::BIGINT AS token_count FROM c""")
def row_batches(t):
    return ordered.row_batches(_order_rows(t), ["o_orderkey"], "orders").select(
        "batch_no", "row_start", "row_end", "total", "chunk_id", "token_count")


@query("""WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1
                            AS i, count(*) OVER (PARTITION BY source) AS total FROM documents)
          SELECT source AS source_id, i // 20 AS batch_no, min(i) AS row_start,
                 max(i) + 1 AS row_end, any_value(total) AS total FROM r GROUP BY 1, 2""")
def row_batches_by_source(t):
    docs = t["documents"].select("source", "doc_id", "lang", "n_chars")
    return ordered.row_batches(docs, ["doc_id"], rows_per_chunk=20, source_column="source"
                               ).select("source_id", "batch_no", "row_start", "row_end", "total")


@query("""SELECT 'orders' AS source_id, o_orderkey, o_custkey, o_orderstatus, o_orderpriority
          FROM orders""")
def rows_from_chunks(t):
    stored = chunk_ops.row_chunks(_order_rows(t), ["o_orderkey"], "orders", "Orders")
    return chunk_ops.rows_from_chunks(
        stored, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                "o_orderpriority string")


@query("SELECT 'documents' AS source_id, '=' || text AS text, doc_id, lang FROM documents")
def texts_from_chunks(t):
    """Whole texts with line breaks and a leading equals sign, through chunks and back."""
    docs = t["documents"].select(F.concat(F.lit("="), "text").alias("text"), "doc_id", "lang")
    stored = chunk_ops.row_chunks(docs, ["doc_id"], "documents", "Documents")
    return chunk_ops.rows_from_chunks(stored, docs.schema.simpleString()[7:-1].replace(":", " "))


_CHUNKS_SQL = """
  SELECT source AS source_id, substring(md5(text), 1, 12) AS chunk_id,
         max(lang) AS chunk_type, max(length(text) // 4)::BIGINT AS token_count
  FROM documents GROUP BY 1, 2"""


def _document_chunks(t):
    """Documents as chunks: equal texts of a source are one chunk."""
    from tablesense.functions.text import short_hash, token_estimate
    return t["documents"].groupBy(
        F.col("source").alias("source_id"), short_hash(F.col("text")).alias("chunk_id")
    ).agg(F.max("lang").alias("chunk_type"), F.max("text").alias("content")).select(
        "source_id", F.upper("source_id").alias("source_name"), "chunk_id", "chunk_type",
        "content", token_estimate(F.col("content")).alias("token_count"),
        F.lit("{}").alias("metadata"))


def _store(t):
    """Chunks saved twice (the second time with a mark and a longer life for one
    language), then one source invalidated and saved again in part."""
    path = scratch_path(t.spark, "chunks")
    first = _document_chunks(t)
    chunkstore.save_chunks(first, path, 3600, _at(0))
    again = first.where(F.col("chunk_type") == "en").withColumn("metadata", F.lit('{"v":2}'))
    chunkstore.save_chunks(again, path, 86400, _at(1))
    chunkstore.invalidate(t.spark, path, "src0", _at(2))
    back = again.where(F.col("source_id") == "src0").withColumn("metadata", F.lit('{"v":3}'))
    chunkstore.save_chunks(back, path, 86400, _at(3))
    return path


@query(f"""SELECT source_id, chunk_id, chunk_type, token_count,
                  CASE WHEN source_id = 'src0' THEN '{{"v":3}}' ELSE '{{"v":2}}' END AS metadata
           FROM ({_CHUNKS_SQL}) WHERE chunk_type = 'en'""")
def stored_chunks(t):
    # four hours on, the first save has expired; only chunks saved again are alive
    live = chunkstore.live_chunks(t.spark, _store(t), _at(4))
    return live.select("source_id", "chunk_id", "chunk_type", "token_count", "metadata")


@query(f"""SELECT chunk_type, chunk_id, token_count FROM ({_CHUNKS_SQL})
           WHERE source_id = 'src1'""")
def loaded_chunks(t):
    # half an hour on, everything is still alive
    return chunkstore.load_chunks(t.spark, _store(t), "src1", _at("0, 30")).select(
        "chunk_type", "chunk_id", "token_count")


@query(f"""SELECT source_id, upper(source_id) AS source_name, count(*) AS n_chunks
           FROM ({_CHUNKS_SQL}) WHERE chunk_type = 'en' GROUP BY 1""")
def cached_sources(t):
    return chunkstore.list_cached(t.spark, _store(t), _at(4)).select(
        "source_id", "source_name", "n_chunks")


@query(f"""SELECT source_id, count(*) AS n_chunks FROM ({_CHUNKS_SQL})
           WHERE chunk_type = 'en' GROUP BY 1""")
def compacted_store(t):
    path, target = _store(t), scratch_path(t.spark, "compacted")
    chunkstore.compact(t.spark, path, target, _at(4))
    return t.spark.read.parquet(target).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_chunks"))


_BUDGET = 3000
_BUDGET_SQL = f"""
  WITH c AS (SELECT source AS source_id, doc_id, text, (length(text) // 4)::BIGINT AS t
             FROM documents),
  w AS (SELECT *, sum(t) OVER (PARTITION BY source_id ORDER BY doc_id) AS upto FROM c),
  f AS (SELECT source_id, min(doc_id) AS stop FROM w WHERE upto > {_BUDGET} GROUP BY 1),
  whole AS (SELECT w.source_id, doc_id AS n, text AS piece FROM w LEFT JOIN f USING (source_id)
            WHERE stop IS NULL OR doc_id < stop),
  lines AS (SELECT w.source_id, doc_id, {_BUDGET} - (upto - t) AS room,
                   unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM w JOIN f ON w.source_id = f.source_id AND w.doc_id = f.stop),
  spent AS (SELECT *, sum((length(line) + 1) // 4) OVER (PARTITION BY source_id ORDER BY i) AS s
            FROM lines),
  cut AS (SELECT source_id, doc_id AS n, string_agg(line, chr(10) ORDER BY i) || chr(10)
                 || '[...truncated to fit token budget]' AS piece
          FROM spent WHERE s <= room GROUP BY 1, 2)
  SELECT source_id, count(*) AS n_chunks,
         md5(string_agg(piece, chr(10) || chr(10) ORDER BY n)) AS context_hash
  FROM (SELECT * FROM whole UNION ALL SELECT * FROM cut) GROUP BY 1"""


@query(_BUDGET_SQL)
def budgeted_context(t):
    from tablesense.functions.text import token_estimate
    docs = t["documents"].select(
        F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("chunk_id"),
        "doc_id", F.lit("rows").alias("chunk_type"), F.col("text").alias("content"),
        token_estimate(F.col("text")).alias("token_count"))
    built = chunk_ops.budgeted_context(docs, _BUDGET, order_col="doc_id")
    return built.select("source_id", "n_chunks", F.md5("context").alias("context_hash"))


@query("""SELECT 'summary' AS chunk_type, 1::BIGINT AS n UNION ALL SELECT 'schema', 1
          UNION ALL SELECT 'stats', 1
          UNION ALL SELECT 'rows', ceil(count(*) / 50)::BIGINT FROM orders""")
def table_chunks(t):
    known = onboard(t["orders"], "orders", "Orders", normalised=True)
    built = chunk_ops.table_chunks(known.table, known.profile, known.roles, ["o_orderkey"],
                                   "orders", "Orders")
    return built.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT '  l_discount: range ' || printf('%.2f', (min(l_discount) + 0.0) * 100) || '% – '
                 || printf('%.2f', max(l_discount) * 100) || '%' AS line FROM lineitem
          UNION ALL
          SELECT '  tax_rate: range ' || printf('%.2f', (min(l_tax) + 0.0) * 100) || '% – '
                 || printf('%.2f', max(l_tax) * 100) || '%' FROM lineitem""")
def percent_range_lines(t):
    from tablesense.operators.profile import profile_columns
    lines = t["lineitem"].select(F.col("l_discount").alias("discount_pct"),
                                 F.col("l_tax").alias("tax_rate"), "l_quantity")
    found = chunk_ops.percent_ranges(profile_columns(lines, "lineitem"))
    return found.select(F.replace("line", F.lit("discount_pct"), F.lit("l_discount")).alias("line"))


# --- exports ----------------------------------------------------------------------------

@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey
                 || ',"o_orderstatus":"' || o_orderstatus || '","ratio":null}' AS record
          FROM orders""")
def json_records(t):
    rows = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus",
                              F.lit(float("nan")).alias("ratio"))
    return export.json_records(rows, ["o_orderkey"])


@query(f"""SELECT o_orderkey, {_ORDER_LINE} AS line FROM orders""")
def csv_preview(t):
    return export.csv_preview(_order_rows(t), ["o_orderkey"])


@query("""SELECT 'orders' AS source_id, '2.0' AS schema_version, count(*) AS total_rows,
                 6 AS total_cols, 'o_orderpriority' AS dimensions, 'o_totalprice' AS measures,
                 'o_orderdate' AS time_cols, 'o_orderstatus' AS status_cols FROM orders""")
def portable_documents(t):
    known = onboard(t["orders"], "orders", "Orders", grain="month", normalised=True)
    back = export.document_from_json(portable_document(known))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return back.select("source_id", "schema_version", "total_rows", "total_cols",
                       *[joined(c) for c in ("dimensions", "measures", "time_cols",
                                             "status_cols")])
