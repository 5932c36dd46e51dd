"""Sort keys for period labels such as `Feb-26`, `2026-02`, `Q1 2026`, `FY26`."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# fixed values: month abbreviations in calendar order
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def period_key(label: Column) -> Column:
    """Months since year 0 for a period label, NULL when the label is not understood."""
    s = F.lower(F.trim(label.cast("string")))
    month_name = F.regexp_extract(s, r"^([a-z]{3})[a-z]*[-\s](\d{2,4})$", 1)
    month_year = F.regexp_extract(s, r"^([a-z]{3})[a-z]*[-\s](\d{2,4})$", 2)
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month_name)
    iso_year = F.regexp_extract(s, r"^(\d{4})[-/](\d{2})", 1)
    iso_month = F.regexp_extract(s, r"^(\d{4})[-/](\d{2})", 2)
    quarter = F.regexp_extract(s, r"^q([1-4])[-\s](\d{2,4})$", 1)
    quarter_year = F.regexp_extract(s, r"^q([1-4])[-\s](\d{2,4})$", 2)
    bare_quarter = F.regexp_extract(s, r"^q([1-4])$", 1)
    fiscal = F.regexp_extract(s, r"^fy\s?(\d{2,4})$", 1)
    bare_year = F.regexp_extract(s, r"^(\d{4})$", 1)
    return (
        F.when(month_no > 0, _year(month_year) * 12 + month_no.cast("int") - 1)
        .when(iso_year != "", _year(iso_year) * 12 + iso_month.try_cast("int") - 1)
        .when(quarter != "", _year(quarter_year) * 12 + (quarter.try_cast("int") - 1) * 3)
        .when(bare_quarter != "", (bare_quarter.try_cast("int") - 1) * 3)
        .when(fiscal != "", _year(fiscal) * 12)
        .when(bare_year != "", _year(bare_year) * 12)
    )


def period_order(df: DataFrame, column: str, min_share=0.85) -> Column:
    """A sort key for a time column: its period key when it is text of which at least
    `min_share` reads as periods, else NULL (the value itself then decides)."""
    if not isinstance(df.schema[column].dataType, StringType):
        return F.lit(None).cast("int")
    key = period_key(F.col(f"`{column}`"))
    read = F.when(F.col(f"`{column}`").isNotNull(), key.isNotNull().cast("double"))
    return F.when(df.agg(F.avg(read)).scalar() >= min_share, key)
