"""Row layout of a document collection."""

from pyspark.sql import types as T

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.StringType()),  # JSON text
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("is_embedded", T.BooleanType()),
    ]
)

# Columns of the three detail levels of a listing.
LEVELS = {
    "none": ["id"],
    "minimal": ["id", "created_at", "updated_at", "is_embedded"],
    "full": DOCUMENT_SCHEMA.fieldNames(),
}

DOCUMENT_COLUMNS = DOCUMENT_SCHEMA.fieldNames()

DEFAULT_LIMIT = 10
DEFAULT_PAGE = 100


def wanted(k: int | None) -> int | None:
    """A limit, or None: all results. Zero and negative numbers mean all, too.

    The default limit of a request is filled in by the request front only.
    """
    return None if k is None or k <= 0 else int(k)
