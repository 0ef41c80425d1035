"""Stored embedding-service answers -> vectors.

Three JSON shapes are read, in this order: a list of numbers, an object with
an ``embedding`` list, and a list of items whose first one holds a list of
vectors.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 200
_NUMBERS = r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>$"


def _numbers_at(doc, path: str) -> Column:
    """The list of numbers at a path, else NULL (also for an empty list)."""
    at = F.try_variant_get(doc, path, "variant")
    values = F.when(F.schema_of_variant(at).rlike(_NUMBERS), F.try_variant_get(doc, path, "array<float>"))
    return F.when(F.size(values) > 0, values)


def parse_payload(raw, dim: int) -> Column:
    """``struct<vector array<float>, error string>`` of a raw answer column."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    doc = F.try_parse_json(raw)
    vector = F.coalesce(
        _numbers_at(doc, "$"), _numbers_at(doc, "$.embedding"), _numbers_at(doc, "$[0].embedding[0]")
    )
    preview = F.when(F.length(raw) > PREVIEW, F.concat(F.substring(raw, 1, PREVIEW), F.lit("..."))).otherwise(raw)
    error = F.when(
        vector.isNull(), F.concat(F.lit("no embedding in answer: "), F.coalesce(preview, F.lit("")))
    ).when(
        F.size(vector) != dim,
        F.concat(F.lit(f"dimension is not {dim} but "), F.size(vector).cast("string")),
    )
    return F.struct(F.when(error.isNull(), vector).alias("vector"), error.alias("error"))
