"""Many filters over one collection in one pass: an inverted filter table.

A filter is a conjunction of conditions. Turned around, every condition lists
the filters that ask for it; documents are exploded into the facts that some
condition asks about. A filter meets documents by an equality join over the
condition that the fewest of them have, and those pass that have all others
too. So the work follows the rarest conditions, not documents times filters.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.filters import metadata_path
from docloom.session import shared_dir

PATHS = 256  # distinct metadata paths read in one pass over the documents
BROADCAST_CONDITIONS = 200_000  # distinct conditions
SEPARATOR = "\x1f"  # between path and value; a path that holds it is never met
PAIRS = 4_000_000  # fact-filter pairs expanded at a time in a task


def _number(value: float) -> str:
    return "n:" + repr(float(value) + 0.0)


def conditions_of(filters: str) -> list[tuple[str, str]] | None:
    """The distinct ``(path, value)`` conditions of a filter as JSON text;
    None for one of a kind that cannot be asked.

    Values are written so that what is compared as equal is equal: true and 1
    are one value, 2024 and 2024.0 too, and no string is a number.
    """
    try:
        asked = json.loads(filters or "{}")
    except ValueError:
        return None
    if not isinstance(asked, dict):
        return None
    found = set()
    for key, value in asked.items():
        if key in ("tag", "tags"):
            if not isinstance(value, str) and (key == "tag" or not isinstance(value, list)):
                return None
            found |= {("", "t:" + t) for t in ([value] if isinstance(value, str) else value) if isinstance(t, str)}
            continue
        try:
            metadata_path(key)
        except ValueError:
            return None
        if SEPARATOR in key:
            found.add(("", "x:"))
            continue
        if isinstance(value, int) and not isinstance(value, bool) and abs(value) >= 2**53:
            found.add((key, f"i:{value}"))
        elif isinstance(value, (bool, int, float)):
            found.add((key, _number(value)))
        else:  # text: a string, or an array or object by its compact JSON
            text = value if isinstance(value, str) else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            found.add((key, "s:" + text))
    return sorted(found)


def compiled(filters) -> Column:
    """A column of filters as JSON text as the list of their conditions."""

    def compile_one(text):
        found = conditions_of(text)
        return None if found is None else [path + SEPARATOR + value for path, value in found]

    def printed(c):  # a number is printed by Spark on both sides
        path = F.split_part(c, F.lit(SEPARATOR), F.lit(1))
        value = F.substr(c, F.length(path) + 2)
        number = F.concat(path, F.lit(SEPARATOR + "n:"), F.substr(value, F.lit(3)).try_cast("double").cast("string"))
        return F.when(value.startswith("n:"), number).otherwise(c)

    return F.transform(F.udf(compile_one, "array<string>", useArrow=True)(filters), printed)


def facts(paths: list[str], tags="tags", metadata="metadata") -> Column:
    """What a document says that conditions on its tags or on some metadata
    paths can ask about, as an array of distinct texts."""
    every = [F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: F.concat(F.lit(SEPARATOR + "t:"), t))]
    for path in paths:
        found = F.try_variant_get(F.try_parse_json(metadata), metadata_path(path), "variant")
        kind = F.schema_of_variant(found)
        is_number = ~kind.rlike("^(STRING|BOOLEAN|VOID|ARRAY|OBJECT)")
        number = F.when(is_number, F.try_variant_get(found, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(found, "$", "boolean").cast("double"))
        whole = F.when(is_number & (F.abs(number) >= float(2**53)), F.try_variant_get(found, "$", "decimal(38,0)").cast("string"))
        text = F.when(kind == "STRING", F.try_variant_get(found, "$", "string")).when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(found))
        values = (("s:", text), ("n:", (number + F.lit(0.0)).cast("string")), ("i:", whole))
        every.append(F.array(*(F.concat(F.lit(path + SEPARATOR + mark), value) for mark, value in values)))
    return F.array_distinct(F.array_compact(F.concat(*every)))


class FilterTable:
    """Conditions turned around: which of some filters ask for each.

    ``conditions``: per filter the list of its conditions. Filters asked more
    than once are counted once.
    """

    def __init__(self, conditions: list[list[str]]):
        filters: dict[tuple, int] = {}
        self.filter_of = np.array([filters.setdefault(tuple(c), len(filters)) for c in conditions], dtype=np.int64)
        self.need = np.array([len(c) for c in filters], dtype=np.int64)
        self.vocabulary = pa.array([c for f in filters for c in f], pa.string()).dictionary_encode()
        codes = self.vocabulary.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        self.filters = np.repeat(np.arange(len(filters)), self.need)[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.vocabulary.dictionary)))])

    def passes(self, facts: pa.Array) -> np.ndarray:
        """``[documents, filters as given]``: does the document pass?"""
        n_docs, n_filters = len(facts), len(self.need)
        met = np.zeros(n_docs * n_filters, np.int32)
        if len(self.vocabulary.dictionary):
            code = pc.index_in(facts.flatten(), self.vocabulary.dictionary)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(n_docs), pc.list_value_length(facts).to_numpy(zero_copy_only=False))[known]
            code = code.drop_null().to_numpy(zero_copy_only=False)
            fan = self.start[code + 1] - self.start[code]
            ends, at = np.cumsum(fan), 0
            while at < len(fan):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                reps = fan[at:stop]
                within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                asking = self.filters[np.repeat(self.start[code[at:stop]], reps) + within]
                met += np.bincount(np.repeat(doc[at:stop], reps) * n_filters + asking, minlength=len(met)).astype(np.int32)
                at = stop
        return (met.reshape(n_docs, n_filters) >= self.need)[:, self.filter_of]


def path_groups(conditions: DataFrame, most: int = PATHS) -> list[tuple[list[str], DataFrame]]:
    """Metadata paths to read together, with the distinct lists of paths that
    they answer. Filters ask about few paths, so this is one group; more than
    ``most`` paths are read in several passes."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform("conditions", lambda c: F.split_part(c, F.lit(SEPARATOR), F.lit(1))), lambda p: p != "")))
    lists = conditions.select(names.alias("paths")).distinct().orderBy("paths")
    groups: list[tuple[set, list]] = []
    for row in lists.toLocalIterator():
        if not groups or len(groups[-1][0] | set(row["paths"])) > most:
            groups.append((set(), []))
        groups[-1][0].update(row["paths"])
        groups[-1][1].append(row["paths"])
    spark = conditions.sparkSession
    one = lambda found: conditions.where(F.lit(True)) if len(groups) == 1 else conditions.join(spark.createDataFrame([(x,) for x in found], "paths array<string>"), names == F.col("paths"), "left_semi")
    return [(sorted(paths), one(found)) for paths, found in groups]


def rarest(lists: DataFrame, told: DataFrame, elements=None) -> DataFrame:
    """Each distinct list of ``lists(conditions)`` with the ``fact`` among its
    conditions that the fewest documents of ``told(facts)`` have, ``n`` of
    them with ``elements`` together. Lists with a condition that no document
    meets are left out. Stored.
    """
    inverted = lists.distinct().select("conditions", F.explode("conditions").alias("fact"))
    size = F.lit(1) if elements is None else elements
    each = told.select(size.cast("long").alias("size"), F.explode("facts").alias("fact"))
    counts = each.groupBy("fact").agg(F.count("*").alias("n"), F.sum("size").alias("elements"))
    met = inverted.join(counts, "fact").groupBy("conditions").agg(F.min(F.struct("n", "fact", "elements")).alias("least"), F.count("*").alias("met"))
    keys = met.where(F.col("met") == F.size("conditions")).select("conditions", "least.fact", "least.n", "least.elements")
    path = shared_dir(lists.sparkSession, "keys")
    keys.write.parquet(path)
    return lists.sparkSession.read.schema(keys.schema).parquet(path)


def with_keys(told: DataFrame, keys: DataFrame) -> DataFrame:
    """``told(facts, ...)`` with the rows of ``keys(fact, ...)`` of each fact
    that it has. Only facts about the paths that keys are about
    are looked up, and where they are read, unless there are very many."""
    path_of = lambda fact: F.split_part(fact, F.lit(SEPARATOR), F.lit(1))
    paths = [r["path"] for r in keys.select(path_of(F.col("fact")).alias("path")).distinct().collect()]  # of one group, so few
    few = keys.count() <= BROADCAST_CONDITIONS
    rows = told.withColumn("fact", F.explode(F.filter("facts", lambda f: path_of(f).isin(paths))))
    return rows.join(F.broadcast(keys) if few else keys, "fact")


def passing(docs: DataFrame, filters: DataFrame, id="id", tags="tags", metadata="metadata") -> DataFrame:
    """``(id, filter_no)``: which documents pass which of ``filters(filter_no,
    filters)``, as ``docs.where(filter_column(...))`` would give for each.

    Equal filters are met once. A document meets a filter only over the
    rarest of its conditions, so what is formed besides the result are the
    documents that have that one and not the others.

    Filters without conditions are left out, as every document passes them;
    so are those of a wrong kind.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "conditions")
    filters.select("filter_no", compiled("filters").alias("conditions")).where(F.size("conditions") > 0).write.parquet(path)
    asked = spark.read.schema(f"filter_no {filters.schema['filter_no'].dataType.simpleString()}, conditions array<string>").parquet(path)
    parts = []
    for paths, group in path_groups(asked):
        told = docs.select(F.col(id).alias("id"), facts(paths, tags, metadata).alias("facts"))
        keys = rarest(group.select("conditions"), told)
        met = with_keys(told, keys.select("fact", "conditions")).where(F.size(F.array_except("conditions", "facts")) == 0)
        parts.append(met.select("id", "conditions").distinct().join(group.distinct(), "conditions").select("id", "filter_no"))
    if not parts:
        return docs.select(F.col(id).alias("id")).limit(0).join(filters.select("filter_no").limit(0))
    return reduce(DataFrame.unionByName, parts)
