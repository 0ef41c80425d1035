"""One front for all kinds of search: hybrid search, tables of requests."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.filters import PATH_RULE
from docloom.functions.text import query_tokens, tokens, with_tokens
from docloom.operators.embed import embed_column
from docloom.operators.filter_join import compiled, facts, path_groups
from docloom.operators.fulltext import ranked, score_text
from docloom.operators.match import Match, PostingsView, TokenView, any_of, phrase, prefix, term
from docloom.operators.postings import TextIndex
from docloom.operators.text_batch import hybrid_hits, query_words, search_hybrid_batch, search_text_batch, text_hits, weigh_queries, with_options
from docloom.operators.topk_join import size_of
from docloom.operators.vector import knn_join, similarity_to
from docloom.schema import DEFAULT_LIMIT
from docloom.session import shared_dir

TYPES = ("fulltext", "vector", "hybrid")
MATCHES_PER_PASS = 256  # distinct text conditions evaluated in one pass over the documents


def search_hybrid(
    df: DataFrame,
    match: Match,
    vector: list[float],
    k: int | None = None,
    filters: dict | None = None,
    id="id",
    digits: int | None = None,
) -> DataFrame:
    """The first k text matches (None: all), ordered by cosine to ``vector`` and then by BM25.

    Adds ``score`` (cosine, NULL without a vector, those come last),
    ``text_score`` and ``rank``.
    """
    scored = score_text(df, match, filters).withColumnRenamed("score", "text_score")
    cosine = F.when(F.size("vector") > 0, similarity_to(vector))
    scored = scored.withColumn("score", cosine if digits is None else F.round(cosine, digits))
    order = [F.col("score").desc_nulls_last(), F.col("text_score"), F.col(id)]
    return ranked(scored, order, k)


def _bad_filters():
    """Filters that are no JSON object, or have a tag condition of the wrong
    kind or an impossible path. One such request must not fail the others."""
    parsed = F.try_parse_json("filters")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit("absent"))
    bad_tag = ~kind("$.tag").isin("STRING", "absent")
    bad_tags = ~kind("$.tags").rlike("^(STRING|ARRAY|absent)")
    bad_path = F.exists(F.coalesce(F.json_object_keys("filters"), F.array().cast("array<string>")), lambda key: ~key.rlike(PATH_RULE))
    empty = F.coalesce("filters", F.lit("")) == ""
    return ~empty & F.coalesce(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT") | bad_tag | bad_tags | bad_path, F.lit(True))


# The reasons as a client knows them.
NO_QUERY, BAD_TYPE = "query is required", "invalid search type: "


def _reason():
    kind = F.coalesce("type", F.lit(""))
    copies = F.count("*").over(W.partitionBy("query_id"))
    return (
        F.when(F.coalesce("query", F.lit("")) == "", F.lit(NO_QUERY))
        .when((kind != "") & ~kind.isin(*TYPES), F.concat(F.lit(BAD_TYPE), kind))
        .when(_bad_filters(), F.lit("invalid filters"))
        .when(F.col("query_id").isNull() | (copies > 1), F.lit("query_id is not unique"))
    )


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Requests that cannot be answered, with the reason."""
    return requests.withColumn("reason", _reason()).where(F.col("reason").isNotNull())


def accepted_requests(requests: DataFrame) -> DataFrame:
    """Requests that can be answered, defaults filled in."""
    kind = F.when(F.coalesce("type", F.lit("")) == "", F.lit("fulltext")).otherwise(F.col("type"))
    k = F.when(F.coalesce("limit", F.lit(0)) > 0, F.col("limit")).otherwise(F.lit(DEFAULT_LIMIT))
    filters = F.when(F.coalesce("filters", F.lit("")) == "", "{}").otherwise(F.col("filters"))
    words = F.col("match") if "match" in requests.columns else F.lit(None).cast("string")
    good = requests.withColumn("_reason", _reason()).where("_reason IS NULL")
    return good.select("query_id", "query", kind.alias("type"), k.cast("int").alias("k"), filters.alias("filters"), F.coalesce(words, F.lit("{}")).alias("match"))


def _parts(match: str) -> tuple[list[Match], list[Match]]:
    """What a request's ``match`` asks for and what it excludes.

    A JSON object with lists: ``phrases`` and ``prefixes`` that must occur,
    ``none`` of these words, and ``any`` of these words.
    """
    asked = json.loads(match)
    wanted = [phrase(*query_tokens(p)) for p in asked.get("phrases", []) if query_tokens(p)]
    wanted += [prefix(p) for p in asked.get("prefixes", []) if query_tokens(p)]
    if asked.get("any"):
        wanted.append(any_of(*asked["any"]))
    return wanted, [term(w) for w in asked.get("none", []) if query_tokens(w)]


def _passes(matches: list[str], view) -> list:
    """One boolean per ``match``, as one column; no column if none has a condition."""
    columns = []
    for wanted, unwanted in map(_parts, matches):
        tests = [p.matches(view) for p in wanted] + [~p.matches(view) for p in unwanted]
        columns.append(reduce(and_, tests) if tests else None)
    if all(c is None for c in columns):
        return []
    return [F.array(*(F.lit(True) if c is None else F.coalesce(c, F.lit(False)) for c in columns)).alias("passes")]


def search_requests(
    docs: DataFrame, requests: DataFrame, embedder, every_word: bool = True, digits: int | None = None,
    index: TextIndex | None = None, **layout,
) -> DataFrame:
    """Answer a table of requests: ``query_id, type, id, score, rank``.

    ``requests``: ``query_id, query, type, limit, filters`` (JSON text), and
    optionally ``match`` (JSON text, see :func:`_parts`) with further
    conditions on the text. All requests of a kind share one pass over the
    documents, however many filters they have: filters are turned around into
    a table of conditions (see ``filter_join``). A query text asks for all its
    words; with ``any`` words in ``match``, or without ``every_word``, for any
    of them. The distinct text conditions are compiled on the driver,
    ``MATCHES_PER_PASS`` at a time, and each becomes one boolean per document.

    With ``index``, a text index of the same documents, no text is read:
    candidates come from the postings of all asked words at once, conditions
    are evaluated on the postings of their words, and only of candidates are
    tags, metadata and vectors looked up, those that some request needs.
    """
    asked = accepted_requests(requests)
    per_request = F.when(F.coalesce(F.json_array_length(F.get_json_object("match", "$.any")), F.lit(0)) > 0, False).otherwise(every_word)
    # stored: the passes below read it several times
    every = _stored(asked.withColumn("every_word", per_request).withColumn("conditions", compiled("filters")).drop("filters"))
    asked, members = _distinct(every)
    parts = [asked.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)]
    last = None
    while True:
        matches = asked.select("match").distinct() if last is None else asked.select("match").distinct().where(F.col("match") > last)
        chunk = [r["match"] for r in matches.orderBy("match").limit(MATCHES_PER_PASS).collect()]
        if not chunk:
            break
        last = chunk[-1]
        numbered = docs.sparkSession.createDataFrame(list(enumerate(chunk)), "filter_no int, match string")
        numbered = asked.join(F.broadcast(numbered), "match").drop("match")
        passes = _passes(chunk, TokenView("_tokens"))
        gate = _Gate(index, chunk) if index else None
        seen = with_tokens(docs, name="_tokens") if passes and not index else docs
        vector = F.when(F.col("is_embedded"), F.col("vector")).alias("vector")
        for paths, group in path_groups(numbered):
            own = [c for c in docs.columns if c != "vector"]
            visible = seen.select(*own, vector, *([] if index else passes), facts(paths).alias("facts"))
            parts += _answers(group if passes else group.drop("filter_no"), visible, embedder, every_word, digits, gate, layout)
    hits = reduce(DataFrame.unionByName, parts).withColumnRenamed("query_id", "first")
    return hits.join(members, "first").select("query_id", "type", "id", "score", "rank")


def _distinct(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One of each set of requests that differ in nothing but their id, and
    ``query_id, type, first``: of every request, which one stands for it."""
    what = F.struct(*(c for c in asked.columns if c != "query_id"))
    rows = asked.select("query_id", what.alias("what"))
    first = _stored(rows.groupBy("what").agg(F.min("query_id").alias("first")))
    members = rows.join(first, "what").select("query_id", F.col("what.type").alias("type"), "first")
    return first.select(F.col("first").alias("query_id"), "what.*"), members


class _Gate:
    """The text conditions of some requests, evaluated on the postings of their words."""

    def __init__(self, index: TextIndex, matches: list[str]):
        self.index, self.matches = index, matches
        parts = [p for wanted, unwanted in map(_parts, matches) for p in (*wanted, *unwanted)]
        self.leaves = [leaf for p in parts for leaf in p.all_leaves()]

    def __call__(self, rows: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """``rows`` with the boolean of each condition. A document without any
        of the words is tested too: it passes where all are excluded."""
        if not self.leaves:
            return rows
        none = F.create_map().cast("map<string, array<int>>")
        rows = rows.join(self.index.places(self.leaves, within), "id", "left").withColumn("places", F.coalesce("places", none))
        return rows.select("*", *_passes(self.matches, PostingsView("places"))).drop("places")


def _from_index(asked: DataFrame, visible: DataFrame, gate: _Gate, every_word: bool, digits: int | None, layout: dict) -> DataFrame:
    """Hits of text requests, and of hybrid ones if there are vectors.

    Documents are read by id and only if a request has a filter or a vector;
    few candidates are sent to that scan, more are met by a join on the id,
    which the grouped postings are already placed by.
    """
    queries = with_options(asked, DEFAULT_LIMIT, every_word)
    bound = size_of(queries, F.size(tokens("query")))
    words = query_words(queries)
    wanted = [c for c, of_queries in (("facts", "conditions"), ("vector", "by_vector")) if of_queries in queries.columns]
    documents, counts, few = gate.index.candidates(words, bound[1], cut=bool(wanted or gate.leaves))
    documents = gate(documents, few)
    if wanted:
        told = visible.select("id", *wanted)
        documents = documents.join(told if few is None else told.join(few, "id", "left_semi"), "id")
    ready = weigh_queries(queries, words, counts, gate.index.totals)
    if "by_vector" in queries.columns:
        return hybrid_hits(queries, ready, documents, bound, F.size("words"), digits, **layout)
    return text_hits(ready, documents, bound, F.size("words"), digits, **layout)


def _answers(
    asked: DataFrame, visible: DataFrame, embedder, every_word: bool, digits: int | None, gate: _Gate | None, layout: dict
) -> list[DataFrame]:
    """Hits of some requests, one pass over the documents for texts and one for vectors."""
    rows = asked.groupBy("type").agg(F.max(F.size("conditions")).alias("most")).collect()  # three at most
    kinds = {r["type"] for r in rows}
    if not any(r["most"] for r in rows):
        asked = asked.drop("conditions")
    by_type = {kind: asked.where(F.col("type") == kind).drop("type") for kind in kinds}
    parts = []
    for kind in kinds & {"vector", "hybrid"}:
        # stored: the embedder must run once per text, and its rows are counted before they are used
        by_type[kind] = _stored(embed_column(by_type[kind], embedder, text="query"))
    if "vector" in kinds:
        parts.append(knn_join(by_type["vector"], gate(visible) if gate else visible, digits=digits, **layout))
    options = {"every_word": every_word, "digits": digits, **layout}
    if "hybrid" in kinds:
        both = by_type["hybrid"].withColumn("by_vector", F.lit(True))
        if "fulltext" in kinds:
            plain = by_type["fulltext"].withColumn("by_vector", F.lit(False))
            both = both.unionByName(plain, allowMissingColumns=True)
        hits = _from_index(both, visible, gate, every_word, digits, layout) if gate else search_hybrid_batch(both, visible, **options)
        parts.append(hits.drop("text_score"))
    elif "fulltext" in kinds:
        plain = by_type["fulltext"]
        parts.append(_from_index(plain, visible, gate, every_word, digits, layout) if gate else search_text_batch(plain, visible, **options))
    return parts


def _stored(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession, "asked")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def responses(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per answered request: ``query_id, query, type, total, results``.

    ``total`` is the number of returned hits; ``results`` holds at most the
    limit of the request, in rank order.
    """
    grouped = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("results"), F.count("*").alias("total")
    )
    none = F.array().cast(grouped.schema["results"].dataType)
    return (
        accepted_requests(requests)
        .select("query_id", "query", "type")
        .join(grouped, "query_id", "left")
        .withColumns({"total": F.coalesce("total", F.lit(0)), "results": F.coalesce("results", none)})
    )
