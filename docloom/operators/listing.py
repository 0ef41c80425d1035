"""Reading documents: by id, by page, pending ones, and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.schema import DEFAULT_PAGE, LEVELS

PAGE_ROWS = 10_000  # rows sorted for a page without looking for its range first
RANGES = 1024  # ranges counted at a time
NO_TIME = -(1 << 62)  # documents without a time come last


def get_documents(df: DataFrame, ids) -> DataFrame:
    """Documents by id: a string, a list, or a DataFrame with an ``id``."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("id").distinct(), "id", "left_semi")
    return df.where(F.col("id").isin([ids] if isinstance(ids, str) else list(ids)))


def project(df: DataFrame, level="minimal") -> DataFrame:
    """Columns of a detail level: ``none``, ``minimal`` or ``full``."""
    return df.select(*LEVELS.get(level, LEVELS["minimal"]))


def list_page(df: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0, id="id", most: int = PAGE_ROWS) -> DataFrame:
    """One page, newest first.

    A page that begins after many rows is found by counting: rows per range
    of times, then per finer range, until at most ``most`` rows are left to
    sort, whatever the offset. The next page is cheaper by
    :func:`list_after`.
    """
    parts = [(df, offset, limit)] if offset + limit <= most else _narrowed(df, limit, offset, id, most)
    newest = F.col("created_at").desc(), F.col(id)
    pages = [rows.orderBy(*newest).offset(skip).limit(n) for rows, skip, n in parts]
    page = reduce(DataFrame.unionByName, pages) if pages else df.limit(0)
    return page if len(pages) < 2 else page.orderBy(*newest)


def list_after(df: DataFrame, created_at, last_id, limit: int = DEFAULT_PAGE, id="id") -> DataFrame:
    """The page after a document, given its time (None: it has none) and id:
    what comes before is not read where files are laid out by time."""
    later = F.col(id) > F.lit(last_id)
    if created_at is None:
        rest = df.where(F.col("created_at").isNull() & later)
    else:
        at = F.lit(created_at).cast("timestamp")
        rest = df.where((F.col("created_at") < at) | ((F.col("created_at") == at) & later) | F.col("created_at").isNull())
    return rest.orderBy(F.col("created_at").desc(), id).limit(limit)


def _page_slots(counts: list[tuple], skip: int, n: int) -> tuple[list[tuple], int, int]:
    """Of ordered ``(key, rows)``: those that hold rows skip..skip + n, the
    rows before them, and their rows."""
    chosen, before, passed = [], 0, 0
    for key, rows in counts:
        if passed + rows > skip and passed < skip + n:
            before = before if chosen else passed
            chosen.append((key, rows))
        passed += rows
    return chosen, before, sum(rows for _, rows in chosen)


def _narrowed(df: DataFrame, limit: int, offset: int, id: str, most: int, low=None, high=None) -> list[tuple[DataFrame, int, int]]:
    """``(rows, skip, n)``: row sets, each with a place to start and a number
    of rows, that make up a page of the times from ``low`` to ``high``."""
    time = F.coalesce(F.unix_micros("created_at"), F.lit(NO_TIME))
    if low is None:
        low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None or not limit:
        return []
    while True:
        width = -(-(high - low + 1) // RANGES)
        slot = F.floor((time - F.lit(low)) / F.lit(width)) if width > 1 else time - F.lit(low)
        inside = df.where(time.between(low, high))
        counts = inside.groupBy(slot.cast("long").alias("slot")).agg(F.count("*").alias("rows")).collect()  # RANGES rows at most
        chosen, before, rows = _page_slots(sorted(((r["slot"], r["rows"]) for r in counts), reverse=True), offset, limit)
        if not chosen:
            return []
        first, last = chosen[0][0], chosen[-1][0]
        offset -= before
        if rows <= most + limit:
            return [(inside.where(slot.between(last, first)), offset, limit)]
        if width == 1 or first != last:
            break
        low, high = low + first * width, min(high, low + (first + 1) * width - 1)
    if first == last:  # many documents of one time
        return [_narrowed_ids(inside.where(slot == first), offset, limit, id, most)]
    # only the first and the last range can be cut; what lies between is in the page whole
    range_of = lambda s: (low + s * width, min(high, low + (s + 1) * width - 1))
    head = min(chosen[0][1] - offset, limit)
    between = sum(n for _, n in chosen[1:-1])
    whole = [(inside.where((slot < first) & (slot > last)), 0, between)] if between else []
    return [*_narrowed(df, head, offset, id, most, *range_of(first)), *whole, *_narrowed(df, limit - head - between, 0, id, most, *range_of(last))]


def _narrowed_ids(rows: DataFrame, skip: int, n: int, id: str, most: int) -> tuple[DataFrame, int, int]:
    """The same among rows of one time, by longer and longer beginnings of the id."""
    length = 0
    while True:
        length += 1
        start = F.substring(F.col(id).cast("string"), 1, length)
        counts = rows.groupBy(start.alias("start")).agg(F.count("*").alias("rows"), F.max(F.length(F.col(id).cast("string"))).alias("longest")).collect()
        ordered = sorted(((r["start"], r["rows"]) for r in counts), key=lambda c: c[0].encode())
        chosen, before, left = _page_slots(ordered, skip, n)
        rows, skip = rows.where(start.between(chosen[0][0], chosen[-1][0])), skip - before
        if left <= most + n or all(r["longest"] <= length for r in counts):
            return rows, skip, n


def pending(df: DataFrame, limit: int, id="id") -> DataFrame:
    """Documents still without a vector, oldest first."""
    return df.where(~F.col("is_embedded")).orderBy("created_at", id).limit(limit)


def collection_stats(df: DataFrame, *by: str) -> DataFrame:
    """Counts and dates of a collection, or per ``db`` / ``db, table``."""
    return df.groupBy(*by).agg(
        F.count("*").alias("document_count"),
        F.count_if("is_embedded").alias("embedded_count"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("last_updated"),
    )


def storage_size(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bytes stored under some paths; file contents are not read."""
    if not paths:
        return spark.createDataFrame([(0,)], "size_bytes long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
