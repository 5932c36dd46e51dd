import time

import pytest
from pyspark.sql import functions as F

from tablesense.session import scratch_path
from tablesense.sources import chunkstore, export, normalise, readers


def test_names_and_nulls(spark):
    df = spark.createDataFrame([(" x ", "N/A", "-"), ("", "(blank)", "y")], " a string, b string, c string")
    df = normalise.fix_columns(df.toDF(" a ", "a", "b  c"))
    assert df.columns == ["a", "a_1", "b c"]
    assert [tuple(r) for r in normalise.fix_nulls(df).collect()] == [
        ("x", None, None), (None, None, "y")]


def test_coercion_threshold(spark):
    good = [("1,000", "12%", "x")] * 17 + [("junk", "junk", "x")] * 2
    df = spark.createDataFrame(good + [("7", "junk", "x")], "a string, b string, c string")
    out = normalise.coerce_numeric(df)
    kinds = dict(out.dtypes)
    assert kinds == {"a": "double", "b": "string", "c": "string"}
    assert out.agg(F.max("a")).first()[0] == 1000.0


def test_pivot_of_measure_pairs(spark):
    long = spark.createDataFrame(
        [("West", "Sales", 1.0), ("West", "Profit", 2.0), ("East", "Sales", 3.0)],
        ["Category", "Measure Names", "Measure Values"])
    rows = {r["Category"]: (r["Profit"], r["Sales"])
            for r in normalise.pivot_measure_names(long).collect()}
    assert rows == {"West": (2.0, 1.0), "East": (None, 3.0)}


def test_empty_parts_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    out = normalise.normalise(df)
    assert out.columns == ["a"] and out.count() == 1
    assert normalise.normalise(df.where("false")).columns == []


def test_first_available_and_failures(spark, harvests):
    path = scratch_path(spark, "t-json")
    harvests.write.json(path)
    found = readers.read_first_available(spark, [("csv", path + "-no"), ("json", path)])
    assert found.select("strategy").distinct().collect()[0][0] == "json" and found.count() == 9
    merged, errors = readers.ingest_batch(
        spark, [("a", "json", path), ("b", "parquet", path + "-no"), ("c", "xml", path)])
    assert merged.count() == 9 and errors.count() == 2


def test_store_versions_expiry_and_invalidation(spark):
    path = scratch_path(spark, "t-store")
    at = lambda h: F.expr(f"timestamp'2026-01-01 00:00:00' + make_dt_interval(0, {h})")
    one = spark.createDataFrame(
        [("s", "S", "c1", "rows", "old", 1, "{}"), ("s", "S", "c2", "rows", "b", 1, "{}")],
        "source_id string, source_name string, chunk_id string, chunk_type string, "
        "content string, token_count int, metadata string")
    chunkstore.save_chunks(one, path, 3600, at(0))
    chunkstore.save_chunks(one.where("chunk_id = 'c1'").withColumn("content", F.lit("new")),
                           path, 7200, at("0, 30"))
    live = lambda now: {r["chunk_id"]: r["content"]
                        for r in chunkstore.load_chunks(spark, path, "s", now).collect()}
    assert live(at("0, 40")) == {"c1": "new", "c2": "b"}
    assert live(at(2)) == {"c1": "new"}
    chunkstore.invalidate(spark, path, "s", at(2))
    assert live(at(2)) == {}
    assert chunkstore.list_cached(spark, path, at(2)).count() == 0


def test_json_records_have_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, v double")
    assert [r["record"] for r in export.json_records(df, ["k"]).collect()] == [
        '{"k":1,"v":null}', '{"k":2,"v":0.5}']
    assert "Rows: 2" in export.preview_text(df, ["k"]).first()[0]


def test_number_like_source_ids_stay_as_written(spark, tmp_path):
    from tablesense.sources import chunkstore
    path = str(tmp_path / "store")
    chunks = spark.createDataFrame(
        [("007", "a", "schema"), ("1e3", "b", "schema")],
        "source_id string, chunk_id string, chunk_type string")
    chunkstore.save_chunks(chunks, path)
    assert {r.source_id for r in chunkstore.live_chunks(spark, path).collect()} == {"007", "1e3"}
    assert chunkstore.load_chunks(spark, path, "007").count() == 1
    chunkstore.invalidate(spark, path, "1e3")
    assert chunkstore.load_chunks(spark, path, "1e3").count() == 0


def test_a_bad_file_costs_its_own_rows_only(spark, harvests, tmp_path):
    """One unreadable parquet file of three, one bad line in each text format, one empty file."""
    import glob
    import json
    harvests.repartition(3).write.parquet(str(tmp_path / "parquet"))
    rows = [r.asDict() for r in harvests.collect()]
    for kind, line in (("csv", lambda r: ",".join(map(str, r.values()))), ("json", json.dumps)):
        (tmp_path / kind).mkdir()
        for i in range(3):
            lines = [",".join(rows[0])] * (kind == "csv") + [line(r) for r in rows[i::3]]
            (tmp_path / kind / f"part{i}.{kind}").write_text("\n".join(lines) + "\n")
    victim = sorted(glob.glob(str(tmp_path / "parquet" / "*.parquet")))[0]
    lost = spark.read.parquet(victim).count()
    with open(victim, "r+b") as file:
        file.write(b"none")
        file.truncate(90)
    harvests.where("false").write.mode("append").parquet(str(tmp_path / "parquet"))
    with open(sorted(glob.glob(str(tmp_path / "csv" / "*.csv")))[0], "a") as file:
        file.write("Marsh,rye\n")
    with open(sorted(glob.glob(str(tmp_path / "json" / "*.json")))[0], "a") as file:
        file.write('{"FARM": "Marsh", \n')
    merged, errors = readers.ingest_batch(spark, [
        (kind, kind, str(tmp_path / kind)) for kind in ("parquet", "csv", "json")] + [
        ("gone", "json", str(tmp_path / "gone"))])
    counts = {r["source_id"]: r["count"] for r in merged.groupBy("source_id").count().collect()}
    assert 0 < lost < 9 and counts == {"parquet": 9 - lost, "csv": 9, "json": 9}
    found = {r["source_id"]: (r["records"], r["path"].rsplit(".", 1)[-1]) for r in errors.collect()}
    assert errors.count() == 4 and found["csv"] == (1, "csv") and found["json"] == (1, "json")
    assert found["parquet"] == (None, "parquet") and found["gone"][0] is None


@pytest.mark.parametrize("streamed", [False, True])
def test_replays_go_while_they_live(spark, tmp_path, streamed):
    """Within a file, across files, and beyond the time to live of an hour."""
    from tablesense.streaming import logs
    files = [[(0, "a"), (0, "a"), (5, "b"), (50, "a")], [(60, "a"), (390, "c"), (390, "d")],
             [(391, "e"), (392, "c")], [(400, "a"), (401, "e")]]
    if not streamed:  # a chain: each row renews, and a gap of more than an hour ends it
        files.append([(450, "a"), (505, "a"), (566, "a")])
    for part in files:
        spark.createDataFrame(part, "m int, k string").select(
            "k", F.timestamp_seconds(F.col("m") * 60 + 1_700_000_000).alias("ts"), "m").coalesce(
            1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    found = spark.read.parquet(str(tmp_path / "in"))
    if streamed:
        stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(
            str(tmp_path / "in"))
        logs.drop_replays(stream, "ts", ["k"]).writeStream.outputMode("append").format(
            "parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        fresh = spark.read.parquet(str(tmp_path / "out"))
    else:
        fresh = logs.drop_replays(found, "ts", ["k"])
    got = {}
    for r in fresh.orderBy("m").collect():
        got.setdefault(r["k"], []).append(r["m"])
    more = [] if streamed else [566]
    assert got == {"a": [0, 400, *more], "b": [5], "c": [390], "d": [390], "e": [391]}
