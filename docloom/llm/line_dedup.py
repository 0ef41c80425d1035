"""Line deduplication by winnowing, with DataFrame operations only.

A text is the sequence of its lines that hold a word. From every window of
MIN_LINES line hashes the smallest is a fingerprint, so a run of that many
lines that two places share puts a fingerprint at the same line of both.
Fingerprints that occur once end there. Around each other one, its windows are
matched and so the match grows both ways, window by window, as far as lines
agree. A window whose lines stand earlier in the corpus is a repeat; the runs
that repeats join to are deleted. A line of MIN_WORDS words is long enough to
be a run of its own.

Common lines cost no more than rare ones: each window keeps only its first
place, found by partial aggregates, and no pairs of places are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column, fresh, stage

MIN_LINES = 2
MIN_WORDS = 50

_SPACES = " \t\n\x0b\f\r"


def _fingerprints(units: Column) -> Column:
    """Distinct places of the window minima; of equal ones the last."""
    keyed = lambda k: F.transform(F.slice(units, k + 1, MIN_LINES), lambda u, j: F.struct(u["h"].alias("h"), (-j).alias("back")))
    least = F.transform(F.sequence(F.lit(0), F.size(units) - MIN_LINES), lambda k: k - F.array_min(keyed(k))["back"])
    return F.array_distinct(F.when(F.size(units) >= MIN_LINES, least).otherwise(F.array().cast("array<int>")))


def _window(units: Column, start: Column, size: int) -> Column:
    lines = F.slice(units, start + 1, size)
    hashes = F.xxhash64(F.lit(size), F.transform(lines, lambda u: u["h"])), F.hash(F.lit(size), F.transform(lines, lambda u: u["m"]))
    return F.struct(hashes[0].alias("g"), hashes[1].alias("g2"), start.cast("int").alias("start"), F.transform(lines, lambda u: u["line"]).alias("lines"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(id, version, lines)``: numbers of the lines in repeats, for each of
    ``docs(id, version, text)`` that has any. Numbers count from 0."""
    units = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            i.alias("line"), F.xxhash64(x).alias("h"), F.hash(x).alias("m"),
            F.size(F.filter(F.split(x, f"[{_SPACES}]+"), lambda w: w != "")).alias("words"),
        ),
    )
    rows = docs.select("id", "version", F.explode(F.array(F.filter(units, lambda u: u["words"] > 0))).alias("units"))
    places = F.transform(_fingerprints(F.col("units")), lambda k: F.struct(k.alias("k"), F.lit(MIN_LINES).alias("size")))
    heavy = F.filter(F.transform("units", lambda u, k: F.when(u["words"] >= MIN_WORDS, F.struct(k.alias("k"), F.lit(1).alias("size")))), lambda x: x.isNotNull())
    units = F.col("units")

    def around_place(at: Column) -> Column:
        """The fingerprint at a place, and the windows that hold it."""
        starts = F.sequence(F.greatest(at["k"] - at["size"] + 1, F.lit(0)), F.least(at["k"], F.size(units) - at["size"]))
        windows = F.transform(starts, lambda s: F.when(at["size"] == 1, _window(units, s, 1)).otherwise(_window(units, s, MIN_LINES)))
        return F.struct(F.xxhash64(at["size"], units[at["k"]]["h"]).alias("print"), windows.alias("windows"))

    fingerprints = rows.select("id", "version", F.explode(F.transform(F.concat(places, heavy), around_place)).alias("f")).select("id", "version", "f.*")
    # what the joins look up is stored first: Spark can then split them at a common line
    shared = stage(fingerprints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "prints")
    around = fingerprints.join(shared.hint("merge"), "print", "left_semi").select("id", "version", F.explode("windows").alias("w")).select("id", "version", "w.*").distinct()
    place = F.struct("id", "version", "start")
    first = stage(around.groupBy("g", "g2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "places")
    later = around.join(first.hint("merge"), ["g", "g2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("id", "version", F.explode("lines").alias("line")).groupBy("id", "version").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the text, and ``n_lines``,
    ``n_removed`` and ``n_runs`` (groups of neighbouring removed lines).

    The first place of a run, by id, text and line, stays; null ids come first.
    Rows with one id and one text count as one row. Lines without a word are
    never part of a run and stay. A null text stays null and has no lines.
    Other columns stay as they are, whatever their names; only columns named as
    the three new ones are replaced. An empty table gives none.
    """
    source = docs.drop("n_lines", "n_removed", "n_runs")
    own, version, other, other_version, gone, lines = fresh(source, "_id", "_version", "_rid", "_rversion", "_gone", "_lines")
    text = column(text_col)
    keyed = source.withColumns({own: column(id_col), version: F.xxhash64(text)})
    repeats = repeated_windows(keyed.where(text.isNotNull()).select(F.col(own).alias("id"), F.col(version).alias("version"), text.cast("string").alias("text")))
    repeats = repeats.select(F.col("id").alias(other), F.col("version").alias(other_version), F.col("lines").alias(gone))
    # merged at every size: a repeat's lines grow with the documents, so the plan must not change with them
    out = keyed.join(repeats.hint("merge"), F.col(own).eqNullSafe(F.col(other)) & (F.col(version) == F.col(other_version)), "left")
    out = out.withColumn(gone, F.coalesce(gone, F.array().cast("array<int>")))
    out = out.select("*", F.explode(F.array(F.split(F.coalesce(text, F.lit("")), "\n"))).alias(lines))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.col(lines)[i])
    runs = F.size(F.filter(F.transform(gone, lambda x, k: (k == 0) | (F.col(gone)[k - 1] != x - 1)), lambda new: new))
    left = F.when(F.size(gone) == 0, text).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *(left.alias(c) if c == text_col else column(c) for c in source.columns),
        F.when(text.isNotNull(), F.size(lines)).otherwise(0).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"),
    )
