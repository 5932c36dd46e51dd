"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its text. The ledger has one
row for each blob and rule version that has been scanned, with its findings; a scan looks
only at pairs the ledger lacks. Findings are joined back to all paths that hold the blob.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablesense.llm.common import own_columns, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost, non-overlapping matches of a pattern, of which those
    stay whose `measured` group (0: all) has at least `least` characters."""
    kind: str
    pattern: str
    least: int = 1
    measured: int = 0
    version: int = 1


#: The kinds in the order that spans at one place are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
         r"([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Spans that the ledger adds to the base ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

LEDGER = "blob binary, kind string, version int, spans array<struct<start:long,stop:long>>"


def blobs(versions: DataFrame) -> DataFrame:
    """(path, blob): each version's content address; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return own_columns(versions, "doc_id", "text").select(
        F.col("doc_id").alias("path"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))


def spans(text: Column, rule: Rule) -> Column:
    """Start and stop, in code points, of a rule's matches that are long enough.

    Splitting at the matches gives the lengths between them; with the matches' own
    lengths, running sums give every place. Matches are counted before any is dropped.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x).cast("long"))
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    whole = F.transform(matches, lambda x: F.char_length(x).cast("long"))
    measured = whole if rule.measured == 0 else F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured)),
        lambda x: F.char_length(x).cast("long"))
    parts = F.zip_with(F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda gap, own:
                                  F.struct(gap.alias("gap"), own.alias("own"))),
                       measured, lambda p, m: F.struct(p["gap"].alias("gap"),
                                                       p["own"].alias("own"), m.alias("m")))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    walked = F.aggregate(
        parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["own"]).alias("at"),
            F.when(p["m"] >= rule.least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + p["gap"]).alias("start"),
                (acc["at"] + p["gap"] + p["own"]).alias("stop"))))).otherwise(
                acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.size(whole) > 0, walked).otherwise(empty)


def scan(versions: DataFrame, paths: DataFrame, ledger: DataFrame, rules) -> DataFrame:
    """Rows for the ledger: blobs and rule versions it does not have yet.

    `paths` is `blobs(versions)`, stored. One path stands for each blob, so that a text
    is read once however many copies it has.
    """
    wanted = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))
              for r in rules]
    chosen = paths.groupBy("blob").agg(F.min("path").alias("path"))
    unseen = chosen.withColumn("rule", F.explode(F.array(*wanted))).select(
        "path", "blob", "rule.kind", "rule.version").join(
        ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    todo = unseen.groupBy("path", "blob").agg(F.collect_set("kind").alias("kinds"))
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = own_columns(versions, "doc_id", "text").select(
        F.col("doc_id").alias("_path"), text.alias("text"))
    met = texts.join(todo, F.col("_path").eqNullSafe(F.col("path"))).where(
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("blob"))
    found = [F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
        F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r)).alias("spans"))
        for r in rules]
    return met.select("blob", F.explode(F.array(*found)).alias("f")).select(
        "blob", "f.kind", "f.version", "f.spans").where("spans IS NOT NULL").dropDuplicates(
        ["blob", "kind", "version"])


def updated(ledger: DataFrame, versions: DataFrame, paths: DataFrame, rules) -> DataFrame:
    """The ledger with what this scan adds, stored."""
    return ledger.unionByName(stored(scan(versions, paths, ledger, rules), "scanned"))


def secrets(versions: DataFrame, ledger: DataFrame | None = None,
            rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per document: doc_id, n_<kind> of every rule, base_sha256, spans, blob.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind as
    listed, joined by commas. base_sha256 is of those of BASE_RULES, the lowercase hex
    SHA-256; `spans` has all. A null text counts as empty, without findings. Matches
    of one kind do not overlap; kinds do not touch one another. Repeated rows come out
    repeated, copies share their blob's findings, a null doc_id is a path like any other.
    An empty table gives an empty result. Other columns are ignored. `ledger` is an earlier
    ledger in LEDGER's columns; only what it lacks is scanned.
    """
    spark = versions.sparkSession
    paths = stored(blobs(versions), "paths")
    if ledger is None:
        ledger = spark.createDataFrame([], LEDGER)
    ledger = updated(ledger, versions, paths, rules)
    order = {r.kind: i for i, r in enumerate(rules)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("kind")]
    current = F.struct(*[F.lit(r.version).alias(r.kind) for r in rules])
    valid = F.lit(False)
    for r in rules:
        valid = valid | ((F.col("kind") == r.kind) & (F.col("version") == current[r.kind]))
    listed = ledger.where(valid & (F.size("spans") > 0)).select(
        "blob", F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), place.alias("place"), F.concat_ws(
                ":", "kind", s["start"].cast("string"), s["stop"].cast("string")).alias("text")
        )).alias("found"))
    by_blob = listed.groupBy("blob").agg(
        F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    all_found = F.coalesce("found", F.array().cast(
        "array<struct<start:bigint,place:int,text:string>>"))
    base = len(BASE_RULES)

    def joined(column):
        return F.array_join(F.transform(column, lambda s: s["text"]), ",")

    def of_rule(i):
        return F.filter(all_found, lambda s: s["place"] == i)

    return paths.join(by_blob, "blob", "left").select(
        F.col("path").alias("doc_id"),
        *[F.size(of_rule(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules)],
        F.sha2(joined(F.filter(all_found, lambda s: s["place"] < base)).cast("binary"), 256).alias(
            "base_sha256"),
        joined(all_found).alias("spans"), F.lower(F.hex("blob")).alias("blob"))
