"""Text helpers as column expressions: number formats, hashes, token estimates."""

from pyspark.sql import Column, functions as F


def has_any(text: Column, words) -> Column:
    """True when the text contains one of the words (plain substring)."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive regular expression test."""
    return text.rlike("(?i)" + pattern)


def token_matches(name: Column, pattern: str) -> Column:
    """Like `matches`, but each alternative must begin or end a token of the name.

    `average_x` is then not a hit for `rag`, while `o_orderstatus` still is one for
    `status`.  Alternatives that carry their own anchors are kept as they are.
    """
    parts = []
    for word in pattern.strip("()").split("|"):
        if word.startswith("^") or word.endswith("$"):
            parts.append(word)
        else:
            parts.append(f"(?:^|[^a-z0-9]){word}")
            parts.append(f"{word}(?:$|[^a-z0-9])")
    return name.rlike("(?i)" + "|".join(parts))


def short_hash(text: Column) -> Column:
    """First 12 hex digits of the MD5 of a text; the id of a chunk."""
    return F.substring(F.md5(text.cast("string")), 1, 12)


def token_estimate(text: Column) -> Column:
    """One token per four characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def format_answer(v: Column) -> Column:
    """Answer style: 0..1 as a percentage, anything else with 3 decimals."""
    return F.when(v.between(0, 1), F.format_string("%.2f%%", v * 100)).otherwise(
        F.format_string("%,.3f", v)
    )


def _scaled(v: Column, one_is_percent: bool) -> Column:
    below_one = F.abs(v) <= 1 if one_is_percent else F.abs(v) < 1
    infinite = v.isin(float("inf"), float("-inf"))
    return (
        F.when(v.isNull() | F.isnan(v) | infinite, F.lit("N/A"))
        .when((v != 0) & below_one, F.format_string("%.2f%%", v * 100))
        .when(F.abs(v) >= 1e6, F.format_string("%.2fM", v / 1e6))
        .when(F.abs(v) >= 1e3, F.format_string("%,.0f", v))
        .otherwise(F.format_string("%.3f", v))
    )


def format_block(v: Column) -> Column:
    """Block style: fractions as %, thousands with commas, millions as M."""
    return _scaled(v.cast("double"), one_is_percent=False)


def format_fact(v: Column) -> Column:
    """Fact style: as `format_block`, with 1 itself shown as a percentage."""
    return _scaled(v.cast("double"), one_is_percent=True)


def spaced(name: str) -> str:
    """A column name with its separators as blanks."""
    return name.replace("_", " ")


def words(text: Column) -> Column:
    """Lower-case runs of two or more word characters, in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
