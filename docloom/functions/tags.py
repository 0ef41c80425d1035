"""Tags as comma-joined text, for importing and exporting flat files."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags_from_csv(text) -> Column:
    """``a,b`` -> ``[a, b]``; empty or missing text -> no tags."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ",", -1))


def tags_to_csv(tags) -> Column:
    return F.coalesce(F.array_join(tags, ","), F.lit(""))
