"""Times sent as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: date, T, time, optional fraction, and Z or an offset.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def parse_time(text) -> Column:
    """The time of an RFC 3339 text; NULL for any other text, and for a date
    or time that does not exist. Digits beyond microseconds are cut off."""
    column = F.col(text) if isinstance(text, str) else text
    short = F.regexp_replace(F.upper(column), "([.][0-9]{6})[0-9]+", "$1")
    return F.when(column.rlike(RFC3339), F.try_to_timestamp(short))
