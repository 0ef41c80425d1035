"""A collection stored as Parquet files under a shared folder.

Documents lie in ``bucket`` directories by a hash of the id. A change writes
new files for the buckets it touches only, then adds one small commit table
that says which write holds each bucket. Readers use the newest commit, so no
file is changed while it is read, and a job that fails before its commit
leaves the collection as it was.

A collection may keep a text index: its segment is written before the commit,
which names it, so documents and index change together or not at all. The
commit also has the last batch of every stream, so whether a batch came before
is read from the newest commit alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import mutate
from docloom.operators.listing import collection_stats, storage_size
from docloom.operators.postings import BROADCAST_GONE, TextIndex
from docloom.schema import DOCUMENT_COLUMNS, DOCUMENT_SCHEMA
from docloom.session import list_dirs, remove_dir, shared_dir

MIN_BUCKETS = 64
FILE_BYTES = 32 << 20  # stored bytes aimed at per file, so per task of a write
BUCKET_BYTES = 128 << 20

MAX_SEGMENTS = 16  # of a kept text index; more are joined into one

_TOTALS = ("document_count", "embedded_count", "created_at", "last_updated", "size_bytes")
_ROW = "bucket int, data_version int, note string, batch long, document_count long, embedded_count long, created_at timestamp, last_updated timestamp, size_bytes long"
_COMMIT = f"{_ROW}, buckets int, index_name string, segment int"


@dataclass(frozen=True)
class _State:
    """What a commit says: which data version holds each filled bucket and
    what is in it, the last batch of each stream, and the text index."""

    version: int = 0
    places: dict[int, int] = field(default_factory=dict)
    totals: dict[int, tuple] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)
    index_name: str | None = None
    segment: int | None = None


def _batch_of(note: str) -> tuple[str, int]:
    """Name and number of a note such as ``stream#7``; numbers of a name grow."""
    name, _, number = note.rpartition("#")
    return (name, int(number)) if name and number.isdecimal() else (note, 0)


class Collection:
    """One table of one database. Single writer.

    A stored collection keeps its number of buckets until ``rebucket``. A new
    one takes ``buckets``, or as many as its first batch needs for
    ``BUCKET_BYTES`` of text each. A write puts ``files_per_bucket`` files into
    each, or as many as its size asks for, so no task grows with it. With ``indexed`` every change keeps a text
    index up to date; a collection that has one keeps it.
    """

    def __init__(
        self, spark: SparkSession, base: str, db: str, table: str, buckets: int | None = None, files_per_bucket: int | None = None, indexed: bool = False
    ):
        self.spark, self.db, self.table = spark, db, table
        self.path = f"{base}/{db}/{table}"
        self.files_per_bucket = files_per_bucket
        newest = self.version()
        stored = self._commits(newest).agg(F.max("buckets"), F.max("index_name")).first() if newest else (None, None)
        self.buckets = stored[0] or buckets
        self.indexed = indexed or stored[1] is not None

    def bucket_of(self, id="id"):
        return F.pmod(F.xxhash64(id), F.lit(self.buckets)).cast("int")

    # -- reading

    def _commits(self, *versions: int) -> DataFrame:
        """Commit tables, each in a folder of its own: only these are read."""
        return self.spark.read.schema(_COMMIT).parquet(*(f"{self.path}/commits/version={v}" for v in versions))

    def _state(self, version: int | None = None) -> _State:
        """A version (default: the newest) from its commit: a row per bucket
        and per stream, so bounded."""
        newest = self.version() if version is None else version
        if newest == 0:
            return _State()
        rows = self._commits(newest).collect()
        places = {r["bucket"]: r["data_version"] for r in rows if r["data_version"] is not None}
        totals = {r["bucket"]: tuple(r[c] for c in _TOTALS) for r in rows if r["data_version"] is not None}
        notes = {r["note"]: r["batch"] for r in rows if r["note"] is not None}
        return _State(newest, places, totals, notes, rows[0]["index_name"], rows[0]["segment"])

    def _commit(self, version: int | None = None) -> tuple[int, dict[int, int]]:
        """A version, and which data version holds each filled bucket in it."""
        state = self._state(version)
        return state.version, state.places

    def _read(self, places: dict[int, int]) -> DataFrame:
        if not places:
            # known to be empty when a join with it is planned, so that the other side is not shuffled
            return self.spark.createDataFrame([], DOCUMENT_SCHEMA).withColumn("bucket", F.lit(0)).where(F.lit(False))
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(places.items())]
        reader = self.spark.read.schema(DOCUMENT_SCHEMA).option("basePath", f"{self.path}/data")
        return reader.parquet(*paths).select(*DOCUMENT_COLUMNS, "bucket")

    def read(self) -> DataFrame:
        """Current documents. The directory column ``bucket`` lets lookups by
        id skip all other directories."""
        return self._read(self._commit()[1])

    def documents(self) -> DataFrame:
        """Current documents with their ``db``, ``table`` and ``bucket``."""
        return self._named(self.read())

    def queue(self) -> DataFrame | None:
        """The documents that wait for a vector, as ``documents``; None if
        there are none.

        Every write leaves in its commit how many documents of each bucket it
        wrote, and how many of them have a vector. So the commit is the queue
        that changes feed: only buckets with documents that wait are opened,
        and none where nothing waits.
        """
        state = self._state()
        waiting = {b: v for b, v in state.places.items() if state.totals[b][1] != state.totals[b][0]}
        return self._named(self._read(waiting)).where(~F.col("is_embedded")) if waiting else None

    def _named(self, docs: DataFrame) -> DataFrame:
        return docs.withColumns({"db": F.lit(self.db), "table": F.lit(self.table)})

    def get(self, *ids: str) -> DataFrame:
        """Documents by id, reading only their buckets."""
        wanted = [F.pmod(F.xxhash64(F.lit(i)), F.lit(self.buckets or 1)).cast("int") for i in ids]
        docs = self.read().where(F.col("bucket").isin(wanted) & F.col("id").isin(list(ids)))
        return docs.drop("bucket")

    def version(self) -> int:
        """Number of the newest commit, by the names of the commit folders."""
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        return [int(name.removeprefix("version=")) for name in list_dirs(self.spark, f"{self.path}/commits")]

    def refresh_index(self, index: TextIndex, since: int, store: bool = False) -> TextIndex:
        """Bring a text index of version ``since`` up to date.

        Of the buckets written after that version, the documents whose text
        is not what it was are tokenized again, and those that are gone are
        dropped. After ``rebucket`` that means all buckets. The result is
        lazy and leaves the index as it is; with ``store`` a stored index
        gets a segment.
        """
        now = self._commit()[1]
        before = self._commit(since)[1]
        fresh = {b: v for b, v in now.items() if v > since}
        changed, gone = self._text_changes(fresh, {b: v for b, v in before.items() if now.get(b, since + 1) > since})
        return index.append(changed, gone) if store else index.update(changed, gone)

    def _text_changes(self, fresh: dict[int, int], stale: dict[int, int]) -> tuple[DataFrame, DataFrame]:
        """Documents whose text is new in some buckets, and ids whose text is no more.

        Texts are compared by hash, and only those of the new ids are taken;
        they are not shuffled while these ids can be sent.
        """
        now, before = (self._read(places).select("id", "content") for places in (fresh, stale))
        keys = [rows.select("id", F.xxhash64("content").alias("_text")) for rows in (before, now)]
        gone, new = (keys[a].join(keys[b], ["id", "_text"], "left_anti").select("id") for a, b in ((0, 1), (1, 0)))
        return now.join(F.broadcast(new) if new.count() <= BROADCAST_GONE else new, "id", "left_semi"), gone

    def index(self) -> TextIndex:
        """The text index as of the newest commit."""
        state = self._state()
        if state.index_name is None:
            raise ValueError("the collection keeps no index, or nothing is stored yet")
        return TextIndex.read(self.spark, f"{self.path}/{state.index_name}", state.segment)

    def size_bytes(self) -> DataFrame:
        """Bytes of the current files."""
        places = self._commit()[1]
        return storage_size(self.spark, [f"{self.path}/data/version={v}/bucket={b}" for b, v in places.items()])

    def has_commit(self, note: str) -> bool:
        """Was a change with this note, or with a later batch of its stream, committed before?"""
        name, number = _batch_of(note)
        return self._state().notes.get(name, -1) >= number

    # -- writing

    def _change(
        self, keys: DataFrame, transform: Callable[[DataFrame, DataFrame], DataFrame], note: str | None, texts: bool = True, stored: str | None = None
    ) -> None:
        """Rewrite the buckets of some ids by a transform of their documents.

        ``keys`` is stored first: every pass over it, here and in the
        transform, sees the same rows, however it was made; ``stored`` is where
        a caller has done so. Without ``texts`` no text changes, and an index
        stays as it is.
        """
        if stored is not None:
            return self._apply(keys, transform, note, texts, stored)
        staged = shared_dir(self.spark, "change")
        keys.write.parquet(staged)
        try:
            self._apply(self.spark.read.schema(keys.schema).parquet(staged), transform, note, texts, staged)
        finally:
            remove_dir(self.spark, staged)

    def _apply(self, keys: DataFrame, transform: Callable[[DataFrame, DataFrame], DataFrame], note: str | None, texts: bool, staged: str) -> None:
        state = self._state()
        if self.buckets is None:
            self.buckets = self._buckets_for(keys)
        touched = [r[0] for r in keys.select(self.bucket_of().alias("bucket")).distinct().collect()]  # at most one row per bucket
        if not touched and note is None:
            return
        current = self._read({b: v for b, v in state.places.items() if b in set(touched)}).drop("bucket")
        size = sum(state.totals[b][4] or 0 for b in touched if b in state.places) + self._stored_bytes(staged)
        self._publish(transform(current, keys), state, touched, note, texts, size)

    def _stored_bytes(self, path: str) -> int:
        """Bytes of a folder of Parquet files."""
        return storage_size(self.spark, [path]).first()[0] or 0

    def _publish(self, rows: DataFrame, state: _State, touched, note: str | None, texts: bool, size: int) -> None:
        """Write the new content of the touched buckets, of about ``size``
        bytes, then the index, then the commit."""
        version = state.version + 1
        data = f"{self.path}/data/version={version}"
        files = self.files_per_bucket or max(1, -(-size // (FILE_BYTES * max(1, len(touched)))))
        split = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(files)).cast("int")
        rows = rows.withColumn("bucket", self.bucket_of())
        # an uncommitted leftover of a failed try is overwritten
        placed = rows.repartitionById(self.buckets * files, F.col("bucket") * files + split)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(data)
        totals = self._bucket_totals(data)
        filled = set(totals)
        if not filled <= set(touched):
            raise RuntimeError(f"buckets {sorted(filled - set(touched))} were written, but are not part of the change")
        kept = [b for b in state.places if b not in set(touched)]
        places = {b: state.places[b] for b in kept} | dict.fromkeys(filled, version)
        totals = {b: state.totals[b] for b in kept} | totals
        notes = state.notes if note is None else state.notes | dict([_batch_of(note)])
        after = replace(state, version=version, places=places, totals=totals, notes=notes)
        if self.indexed and (texts or state.index_name is None):
            after = self._publish_index(state, after, set(touched))
        self._write_commit(after)

    def _bucket_totals(self, data: str) -> dict[int, tuple]:
        """Counts, dates and bytes of the buckets of a write: a row each."""
        rows = self.spark.read.schema("is_embedded boolean, created_at timestamp, updated_at timestamp, bucket int").parquet(data)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(data)
        bucket = F.regexp_extract("path", r"/bucket=(\d+)/[^/]*$", 1).cast("int").alias("bucket")
        sizes = files.where(F.col("path").contains("/bucket=")).select(bucket, "length").groupBy("bucket").agg(F.sum("length").alias("size_bytes"))
        totals = collection_stats(rows, "bucket").join(sizes, "bucket", "left")
        return {r["bucket"]: tuple(r[c] for c in _TOTALS) for r in totals.collect()}

    def _publish_index(self, state: _State, after: _State, touched: set[int]) -> _State:
        """Write the index of a change. Until the commit names it, it is not
        read; a failed try's segment has the same number and is replaced."""
        if state.index_name is None:
            name = f"index-{after.version}"
            TextIndex.build(self._read(after.places)).write(f"{self.path}/{name}", over_failed=True)
            return replace(after, index_name=name, segment=0)
        fresh = {b: v for b, v in after.places.items() if b in touched}
        changed, gone = self._text_changes(fresh, {b: v for b, v in state.places.items() if b in touched})
        index = TextIndex.read(self.spark, f"{self.path}/{state.index_name}", state.segment).append(changed, gone, over_failed=True)
        if index.segment < MAX_SEGMENTS:
            return replace(after, segment=index.segment)
        name = f"index-{after.version}"
        index.write(f"{self.path}/{name}", over_failed=True)
        return replace(after, index_name=name, segment=0)

    def _write_commit(self, state: _State) -> None:
        """One row per filled bucket and per stream; at least one."""
        rows = [(b, v, None, None, *state.totals[b]) for b, v in sorted(state.places.items())]
        none = (None,) * len(_TOTALS)
        rows += [(None, None, name, number, *none) for name, number in sorted(state.notes.items())]
        commit = self.spark.createDataFrame(rows or [(None, None, None, None, *none)], _ROW).coalesce(1)
        named = commit.withColumns({"buckets": F.lit(self.buckets), "index_name": F.lit(state.index_name).cast("string"), "segment": F.lit(state.segment).cast("int")})
        named.write.mode("overwrite").parquet(f"{self.path}/commits/version={state.version}")

    @staticmethod
    def _buckets_for(docs: DataFrame) -> int:
        if "content" not in docs.columns:
            return MIN_BUCKETS
        size = docs.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
        return max(MIN_BUCKETS, -(-size // BUCKET_BYTES))

    def rebucket(self, buckets: int | None = None) -> None:
        """Write the collection anew in another number of buckets (None: as
        many as its size asks for), as one change."""
        docs = self.read().drop("bucket")
        self.buckets = buckets or self._buckets_for(docs)
        state = self._state()
        size = sum(total[4] or 0 for total in state.totals.values())
        self._publish(docs, replace(state, places={}, totals={}), range(self.buckets), None, False, size)

    def upsert(self, batch: DataFrame, as_of=None, order: str | None = None, note: str | None = None, stored: str | None = None) -> None:
        """Insert or replace documents; ids that are missing are drawn once.

        ``stored``: the folder that the batch is read from, if it was written
        for this change and all its rows have an id.
        """

        def changed(current, batch):
            unique = batch.groupBy("id").count().where("count > 1").isEmpty()  # narrow: texts are not shuffled for it
            return mutate.upsert(current, batch, as_of, order, unique, batch.count() <= BROADCAST_GONE)

        self._change(batch if stored else mutate.with_ids(batch), changed, note, stored=stored)

    def delete(self, ids: DataFrame, note: str | None = None) -> None:
        self._change(ids.select("id"), mutate.delete, note)

    def update_vectors(self, vectors: DataFrame, as_of=None, note: str | None = None) -> None:
        self._change(vectors, lambda current, vectors: mutate.update_vectors(current, vectors, as_of), note, texts=False)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove the files that none of the ``keep`` newest versions uses.

        Returns the removed data versions. Readers of older versions must
        have finished. Older commits go as well: the newest has all notes.
        """
        versions = self._versions()
        if not versions:
            return []
        newest, oldest = max(versions), self._state(min(versions))  # what is older is used by the oldest, or removed
        kept = [self._state(n) for n in range(max(1, newest - keep + 1), newest + 1)]
        used, indexes = {v for state in kept for v in state.places.values()}, {state.index_name for state in kept}
        written = range(oldest.version, newest + 1)
        gone = sorted(({*written} | {*oldest.places.values()}) - used)
        for version in gone:
            remove_dir(self.spark, f"{self.path}/data/version={version}")
        for name in {oldest.index_name, *(f"index-{v}" for v in written)} - {None} - indexes:
            remove_dir(self.spark, f"{self.path}/{name}")
        for version in versions:
            if version <= newest - keep:
                remove_dir(self.spark, f"{self.path}/commits/version={version}")
        return gone


def _stored_names(spark: SparkSession, base: str) -> list[tuple[str, str]]:
    """Database and table of all stored collections under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    try:
        commits = files.load(f"{base}/*/*/commits/*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    name = F.regexp_extract("path", r"([^/]+)/([^/]+)/commits/", 1), F.regexp_extract("path", r"([^/]+)/([^/]+)/commits/", 2)
    found = commits.select(name[0].alias("db"), name[1].alias("table")).distinct().orderBy("db", "table")
    return [(r["db"], r["table"]) for r in found.collect()]


def open_all(spark: SparkSession, base: str) -> list[Collection]:
    """All stored collections under a folder, by database and table."""
    return [Collection(spark, base, db, table) for db, table in _stored_names(spark, base)]


def list_databases(spark: SparkSession, base: str) -> DataFrame:
    """One row per database: counts and dates over all its collections, and
    the bytes of their current files.

    Every write has left the totals of its buckets in its commit, so this is
    one scan of the newest commits and reads no document. An emptied database
    stays listed.
    """
    newest = []
    for db, table in _stored_names(spark, base):
        versions = [int(name.removeprefix("version=")) for name in list_dirs(spark, f"{base}/{db}/{table}/commits")]
        newest += [f"{base}/{db}/{table}/commits/version={max(versions)}"] if versions else []
    if not newest:
        none = "name string, document_count long, embedded_count long, created_at timestamp, last_updated timestamp, size_bytes long"
        return spark.createDataFrame([], none)
    rows = spark.read.schema(_COMMIT).parquet(*newest)
    db = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+/commits/version=\d+/[^/]*$", 1)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("document_count", "embedded_count", "size_bytes")]
    dates = [F.min("created_at").alias("created_at"), F.max("last_updated").alias("last_updated")]
    return rows.groupBy(F.url_decode(db).alias("name")).agg(*sums[:2], *dates, sums[2])
