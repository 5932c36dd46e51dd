"""The block catalogue: which pre-computed aggregates a table gets, from its roles."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablesense.operators import aggregate, select
from tablesense.operators.roles import TableRoles


@dataclass(frozen=True)
class Block:
    """One lazily computed aggregate with its identity."""

    agg_id: str
    agg_type: str
    title: str
    data: DataFrame


def aggregation_blocks(df: DataFrame, roles: TableRoles) -> list[Block]:
    """All blocks that fit a table with visual roles.  Nothing runs until a block is
    read; every block has all its rows."""
    dims, meas = roles.dimensions, roles.measures
    times, stats, thresholds = roles.times, roles.statuses, roles.thresholds
    geos, bins, flags = (roles.names(r) for r in ("geographic", "bin", "boolean"))
    out = []
    if meas:
        out.append(Block("summary_stats", "kpi", "Summary Statistics (all measures)",
                         aggregate.summary_stats(df, meas)))
    for c in dims + stats:
        out.append(Block(f"dist_{c}", "dist",
                         f"Distribution: {c} ({roles.unique(c)} unique values)",
                         aggregate.distribution(df, c).orderBy(F.desc("count"), "value")))
    series = dims[0] if dims else None
    for t in times:
        for m in meas:
            data = aggregate.time_series(df, t, m, series)
            suffix = f"_{series}" if series else ""
            order = ["period", "series"] if series else ["period"]
            out.append(Block(f"ts_{t}_{m}{suffix}", "trend",
                             f"Trend: {m} over {t}" + (f" by {series}" if series else ""),
                             data.orderBy(*order)))
    for m in meas:
        for d in dims:
            out.append(Block(f"topn_{m}_{d}", "top_n", f"Top 10: {m} by {d}",
                             aggregate.top_n(df, m, d)))
    if len(dims) >= 2 and meas:
        a, b = dims[:2]
        out.append(Block(f"xtab_{a}_{b}", "cross", f"Cross-tab: {meas[0]} by {a} × {b}",
                         aggregate.cross_cells(df, a, b, meas[0])))
    if len(meas) >= 2:
        out.append(Block("correlation", "corr", f"Correlation Matrix ({len(meas)} measures)",
                         aggregate.correlation_pairs(df, meas)))
    for m in meas:
        for t in thresholds:
            out.append(Block(f"breach_{m}_{t}", "breach",
                             f"Threshold Breach: {m} vs {t}",
                             select.breach_analysis(df, m, t, [*dims[:1], *stats[:1]])))
    for g in geos:
        if meas:
            out.append(Block(f"geo_{g}_{meas[0]}", "geo",
                             f"Geographic: {meas[0]} by {g}",
                             aggregate.geo_aggregate(df, g, meas[0])))
    for m in meas:
        if roles.unique(m) >= 5:
            out.append(Block(f"hist_{m}", "hist", f"Distribution: {m} (histogram)",
                             aggregate.histogram(df, m).orderBy("bin")))
    for b in bins:
        if meas:
            out.append(Block(f"bin_{b}", "hist", f"Binned: {meas[0]} by {b}",
                             aggregate.bin_aggregate(df, b, meas[0])))
    for f in flags:
        if meas:
            out.append(Block(f"bool_{f}", "dist", f"Boolean/Set: {f}",
                             aggregate.flag_summary(df, f, meas[0])))
    return out


def blocks_long(blocks: list[Block]) -> DataFrame:
    """All blocks as rows of (agg_id, agg_type, title, cells)."""
    out = None
    for b in blocks:
        cells = F.map_from_arrays(
            F.array(*[F.lit(c) for c in b.data.columns]),
            F.array(*[F.col(f"`{c}`").cast("string") for c in b.data.columns]))
        rows = b.data.select(F.lit(b.agg_id).alias("agg_id"), F.lit(b.agg_type).alias("agg_type"),
                             F.lit(b.title).alias("title"), cells.alias("cells"))
        out = rows if out is None else out.unionByName(rows)
    return out
