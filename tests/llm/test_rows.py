"""Scores, rules, mixing and archives, the pipeline, and the registered queries."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import line_dedup, mixing, quality_classifier, quality_rules, toxicity, warc
from docloom.llm.common import held_out
from docloom.llm.oracles import SQL
from docloom.llm.queries import QUERIES
from docloom.sources.tables import load
from tests.checking import compare, connect
from tests.llm.test_pairs import edge_rows, frame, prose

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality rules


def brute_measures(text):
    text = text or ""
    words, lines, seen = WORDS.findall(text), text.split("\n"), set()
    repeated = 0
    for line in lines:
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    windows, covered = defaultdict(list), set()
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    for places in windows.values():
        if len(places) > 1:
            covered.update(x for k in places for x in range(k, k + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


def test_quality_rules(spark):
    rng = random.Random(8)
    rows = edge_rows() + [(i, prose(rng, 60, 3) + "\n" + "#|$ x\n" * (i % 3) + "\x0b a\r\n") for i in range(300, 330)] + [(400, "| < >\n" * 40), (401, "  a b")]
    got = quality_rules.apply_rules(frame(spark, rows)).collect()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r.doc_id, *(r[c] for c in columns)) for r in got) == Counter((i, *brute_measures(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.apply_rules(frame(spark, rows).where("false")).collect() == []


def test_quality_rules_verdicts(spark):
    good = "The house of the man is in the middle of a small town, and it was built by his father for the people that live there."
    rows = [(1, good), (2, good.upper().replace(" ", "!! ")), (3, " | ".join(good.split())), (4, " ".join(w + "###" for w in good.split())), (5, "This this this this. " + "very very very very " * 9)]
    verdicts = {r.doc_id: r.kept for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    assert verdicts[1] and not any(verdicts[k] for k in (3, 4, 5))
    broken = quality_rules.measures(frame(spark, rows)).select("doc_id", quality_rules.failed_rules().alias("f"))
    assert {r.doc_id: r.f for r in broken.collect()}[3] == ["symbols_per_word", "words_with_letters"]  # a bar is a word without letters


def test_quality_rules_run_no_python(spark):
    plan = quality_rules.apply_rules(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- classifiers


def labelled_rows(seed=1, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, 60, 900).capitalize() + "." if good else "".join(w.upper() + "!! " for w in prose(rng, 60, 900).split())
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_classifier_on_held_out_rows(spark):
    rows, labels = labelled_rows()
    more = [(900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1])]
    bad_labels = [(5, 1 - labels[5][1], 0), (None, 1, 1), (7, 9, None), (12345, 1, 1)]
    known = spark.createDataFrame(labels + bad_labels, "doc_id long, quality int, toxic int")
    scored = quality_classifier.quality(frame(spark, rows + more), known).select("doc_id", "score", held_out().alias("held_out")).collect()
    assert len(scored) == len(rows) + 4
    assert all(0 <= r.score <= 1 for r in scored)
    truth = {i: q for i, q, _ in labels}
    assert all((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in scored if r.held_out and r.doc_id in truth)
    assert {r.score for r in scored if r.doc_id in (900, 901)} == {next(r.score for r in scored if r.doc_id == 900)}


@pytest.mark.parametrize("score", [lambda d, x: quality_classifier.quality(d, x), lambda d, x: toxicity.toxicity(d, x)])
def test_classifiers_without_labels_or_rows(spark, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(score(frame(spark, edge_rows()), none).collect()) == len(edge_rows())
    assert score(frame(spark, []).where("false"), none).collect() == []


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8)) if k % 2 else np.unique(rng.integers(30, 80, 8)) for k in range(200)]
    labels = np.arange(200) % 2
    counts = np.ones((2, 80))
    for r, y in zip(rows, labels):
        counts[y, r] += 1
    weights = quality_classifier.fit(rows, labels, np.log(counts[1] / counts[0]))
    assert ((quality_classifier.margins(rows, weights) > 0) == (labels == 1)).mean() > 0.95


@pytest.fixture(scope="module")
def costs(spark):
    text = load(spark, "/root/testdata/sf0.01", "documents").select("text")
    return toxicity.language_model(text)


@pytest.mark.parametrize(
    "seen, meant",
    [
        ("you 1d10t there", "you idiot there"), ("an i d i o t said", "an idiot said"), ("a m.o.r.o.n and", "a moron and"), ("tr@sh of it", "trash of it"),
        ("stuuuupid man", "stupid man"), ("p4th3t1c", "pathetic"), ("l-o-s-e-r", "loser"), ("$tup1d", "stupid"), ("c l 0 w n the", "clown the"),
        ("plain words, 3.0 of them.", "plain words, 3.0 of them."), ("a a a a a a", "a a a a a a"), ("", ""), (None, ""),
    ],
)
def test_restored_text(costs, seen, meant):
    assert toxicity.restore(seen, costs) == meant


@pytest.mark.parametrize("seen, meant", [("iiddiioott", "idiot"), ("mo.ron", "moron"), ("id--iot", "idiot"), ("st-upid", "stupid"), ("mo ro n", "moron"), ("mo r o n", "moron"), ("M*o*ron", "moron")])
def test_evidence_of_light_disguises(costs, seen, meant):
    texts = [f"Someone, {seen}, whatever", f"nothing {meant} nothing"]
    hashes, rows, _ = toxicity.evidence(*toxicity.buffers(toxicity.pa.array(texts)), costs)
    word, *_ = toxicity._words_and_prefixes(*toxicity.buffers(toxicity.pa.array([meant])))
    assert word[0] in hashes[rows == 0] and word[0] in hashes[rows == 1]


def test_many_spans_decode_as_one_by_one(costs):
    rng = random.Random(2)
    spans = ["".join(rng.choice("aabbeeiioorrsstt 10@$*.-é\u0130") for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["x" * 90, ""]
    assert toxicity.decode_all(spans, costs) == [toxicity.decode(x, costs) for x in spans]


def test_restored_spans_of_any_length(costs):
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000))
    plain = toxicity.restore(f"an {word} said", costs)
    assert plain.startswith("an ") and plain.endswith(" said") and len(plain) > 150_000
    for before in range(8):  # the word lies on every place around a multiple of 64 characters
        spaced = "x y " * 13 + "z " * before + "i d i o t" + " q k" * 20
        assert "idiot" in toxicity.restore(spaced, costs)
    assert "idiot" in toxicity.restore("q k " * 25_000 + "i d i o t" + " q k" * 25_000, costs)


def test_language_model_counts_all_rows(spark):
    docs = spark.createDataFrame([("abab",), (None,), ("",), ("x  \n y",)], "text string")
    counts = {r.gram: r.n for r in docs.mapInArrow(toxicity._gram_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    assert sum(counts.values()) >= 4
    again = docs.repartition(3).mapInArrow(toxicity._gram_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    inner = {k: v for k, v in counts.items() if 0 not in [k // 28**p % 28 for p in range(4)]}
    assert inner == {r.gram: r.n for r in again.collect() if r.gram in inner}


def test_toxicity_of_hidden_words(spark):
    rng = random.Random(11)
    known_words = ["".join(rng.choice(["ba", "lo", "mi", "ter", "sun", "de"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]

    def prose(rng, n):  # of letters
        return " ".join(rng.choice(known_words) for _ in range(n))

    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        words = prose(rng, 40).split()
        if bad:
            words.insert(rng.randrange(40), rng.choice(["grobnik", "slimewad"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    hidden = [(1000, prose(rng, 30) + " gr0bn1k " + prose(rng, 30)), (1001, "s l i m e w a d " + prose(rng, 9)), (1002, "groooobnik it is"), (1003, prose(rng, 60)), (1004, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, rows + hidden), known).collect()}
    assert all((scores[i] >= 0.5) == (i % 5 == 0) for i in range(500))
    assert [scores[i] >= 0.5 for i in range(1000, 1005)] == [True, True, True, False, False]
    left = toxicity.remove_toxic(frame(spark, rows + hidden), known)
    assert left.columns == frame(spark, []).columns and left.count() == 402


def test_copies_push_no_word_out_of_the_model(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    common = [word() for _ in range(300)]
    copied = " ".join(word() for _ in range(70_000))
    rows = [(i, copied) for i in ids[:10]]
    for i in ids[10:200]:
        words = [rng.choice(common) for _ in range(30)]
        rows.append((i, " ".join([*words[:15], "grobnik", *words[15:]] if i in ids[10:18] else words)))
    known = spark.createDataFrame([(i, 1, int(n < 18)) for n, (i, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(1000, "so grobnik it is"), (1001, " ".join(copied.split()[:20])), (None, None), (1002, "")])
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, known).collect()}
    assert scores[1000] == 8 / (8 + 0 + toxicity.PRIOR)
    assert 0 < scores[1001] < 0.5 and scores[1002] == scores[None] == 0
    monkeypatch.setattr(toxicity, "SENT", 5)  # the joins give the same
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, known).collect()} == scores
    left = toxicity.remove_toxic(docs, known)
    assert left.schema == docs.schema and Counter(r.doc_id for r in left.collect()) == Counter(i for i, x in scores.items() if x < 0.5)


# -- mixing


def test_mixing_rates_and_shuffle(spark):
    rows = [(i, "big" if i % 10 else "small", "k") for i in range(4000)] + [(5000, None, "k"), (None, "small", "k"), (0, "small", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, copy string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), (None, 0.0), ("absent", 5.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights, total=6000).collect()
    per_source = Counter(r.source for r in got)
    assert abs(per_source["big"] - 3000) < 250 and abs(per_source["small"] - 3000) < 350 and None not in per_source
    assert Counter((r.doc_id, r.copy) for r in got) == Counter((r.doc_id, r.copy) for r in mixing.mix_sources(docs.repartition(5), weights, total=6000).collect())
    keys = [r.mix_key for r in got if r.doc_id]
    assert len(set(keys)) >= len(keys) - 20
    assert mixing.mix_sources(docs.where("false")).collect() == []


CLASHES = ["_id", "_version", "_rid", "_RVERSION", "_gone", "_lines", "_key", "_nth", "_row", "_score", "_other", "_source", "_parts", "_cdf", "_part", "_count", "a.b"]


def clashing(docs):
    """The rows with columns named as the operators' own."""
    return docs.select("*", *(F.lit(f"{name}!").alias(name) for name in CLASHES))


def untouched(df):
    """No row has another value in them."""
    return df.where(" OR ".join(f"NOT `{name}` <=> '{name}!'" for name in CLASHES)).count() == 0


@pytest.mark.parametrize("sent", [mixing.SENT, 0])
def test_columns_with_clashing_names(spark, monkeypatch, sent):
    """Both layouts of the mixing join and of the toxic words, too."""
    monkeypatch.setattr(mixing, "SENT", sent)
    monkeypatch.setattr(toxicity, "SENT", sent or 1)
    rows = [(i, f"first line\nsecond line\nline {i}\n" * (1 + i % 2), "s" if i % 7 else "t") for i in range(40)] + [(None, None, None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for run in (line_dedup.deduplicate_lines, mixing.mix_sources, lambda d: toxicity.remove_toxic(d, known)):
        got, plain = run(clashing(docs)), run(docs)
        assert got.columns[: len(docs.columns) + len(CLASHES)] == clashing(docs).columns and untouched(got)
        assert Counter(got.select(*plain.columns).collect()) == Counter(plain.collect())
        assert run(clashing(docs).where("false")).collect() == []


def test_fit_takes_no_more_rows_than_its_bound(spark, monkeypatch):
    """A repeated id, and a row that is repeated, do not exceed or fill the sample."""
    sizes, plain = [], quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "SAMPLE", 50)
    monkeypatch.setattr(quality_classifier, "fit", lambda rows, *rest: sizes.append(len(rows)) or plain(rows, *rest))
    rows, labels = labelled_rows(n=30)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows += [(1, f"text {i} of one id") for i in range(400)] + [rows[2]] * 400
    quality_classifier.quality(frame(spark, rows), known)
    assert max(sizes) == 50
    sizes.clear()
    rows = rows[:30] + [rows[2]] * 400
    quality_classifier.quality(frame(spark, rows), known)
    assert max(sizes) == len({i for i, _ in rows if zlib.crc32(str(i).encode()) % 5})


def test_poisson_counts(spark):
    """Mean and variance of the counts, also of a mean that is split."""
    for rate in (0.7, 100.0):
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
        times = mixing.mix_sources(docs, total=int(3000 * rate)).groupBy("doc_id").count().collect()
        counts = np.array([r["count"] for r in times] + [0] * (3000 - len(times)))
        assert abs(counts.mean() - rate) < 5 * (rate / 3000) ** 0.5
        assert abs(counts.var() / rate - 1) < 0.15


# -- archives


def pages():
    return [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (4, "u\r\nEvil: 1", ""), (5, "http://c", "é" * 3000), (None, "http://d", "<p>x</p>"), (6, "http://e", "WARC/1.1\r\n\r\n"), (1, "http://f", "<p>x</p>")]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*p, "other") for p in pages()], "page_id long, url string, html string, kind string")
    for least in (0, 9):
        first = {}
        for i, _, html in pages():
            payload = (html or "").encode()
            if i is not None:
                first[payload] = min(first.get(payload, i), i)
        want = Counter()
        for i, url, html in pages():
            payload = (html or "").encode()
            again = len(payload) >= least and i != first[payload]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            want[i, len(payload), digest, "revisit" if again else "response", first[payload] if again else None, (url or "").replace("\r\n", "") or None] += 1
        assert Counter(tuple(r) for r in warc.archive_pages(df, least).collect()) == want
    assert warc.archive_pages(df.where("false")).collect() == []


def test_members_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    whole = warc.write_archives(warc.revisits(df).coalesce(1))
    assert whole.count() > 1
    members = warc.normalise(whole)
    assert members.agg(F.sum("records")).first()[0] == len(pages())
    for r in members.collect():
        system, path = fs.FileSystem.from_uri(r.path) if "://" in r.path else (fs.LocalFileSystem(), r.path)
        raw = system.open_input_file(path).read()
        index = system.open_input_file(path + ".idx").read().decode().splitlines()
        assert len(index) == r.records
        parts = [zlib.decompress(raw[int(a) : int(a) + int(b)], 31) for a, b in (x.split("\t")[:2] for x in index)]
        assert b"".join(parts) == gzip.decompress(raw) and all(p.startswith(b"WARC/1.1\r\n") for p in parts)


def test_streams_that_end_early():
    raw = warc.record(1, "u", b"payload" * 999, "response", None)
    packed = gzip.compress(raw)
    assert list(warc.split_records(warc.inflate(io.BytesIO(packed + gzip.compress(raw))))) == [raw, raw]
    for stream in (packed[:-20], gzip.compress(raw[:-3]), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.split_records(warc.inflate(io.BytesIO(stream))))


# -- pipeline and registry


def brute_stages(rows):
    """Ids that stay after each filtering stage, worked out on the stage's own input."""
    from tests.llm.test_pairs import brute_components, brute_hits, brute_lines

    return {
        "line_dedup": lambda rows, _: {i for (i, t, n), _ in brute_lines(rows).items() if not n or WORDS.search(t)},
        "near_dedup": lambda rows, _: {i for i, _, c, kept in brute_components(rows) if kept},
        "decontamination": lambda rows, items: {i for i, _, n, _ in brute_hits(rows, items) if not n},
    }


def test_pipeline_stages(spark):
    docs = load(spark, SF, "documents").limit(0).union(load(spark, SF, "documents"))
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    brute = brute_stages(None)
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = step(spark, docs, SF)
        if name != "mixing":
            assert out.columns == columns and out.schema == docs.schema
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        if name in brute:
            assert {r.doc_id for r in rows} == brute[name](before, items)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in load(spark, SF, "labels").collect()}
            assert {i for i, _ in before} - {r.doc_id for r in rows} <= {i for i, _ in before if labels.get(i) != 0}
        if name == "mixing":
            assert {r.doc_id for r in rows} <= {i for i, _ in before} and {"copy", "mix_key"} < set(out.columns)


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(i, t, None if n % 3 else "en", None if n % 4 else "s", None) for n, (i, t) in enumerate(edge_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.where("false")):
        for name, step in corpus_pipeline.STAGES:
            some = spark.createDataFrame(step(spark, some, SF).collect(), some.schema if name != "mixing" else step(spark, some, SF).schema)
    assert some.count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_a_query_per_operator_and_pipeline():
    from __spark_entry__ import queries

    names = sorted(queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_columns(spark, name):
    rows = QUERIES[name](spark, SF)
    table = {"op12_embedding_whitening": "embeddings", "op13_conversation_repair": "conversations"}.get(name, "documents")
    what = "count(DISTINCT conv_id)" if table == "conversations" else "count(*)"
    total = duckdb.execute(f"SELECT {what} FROM '{SF}/{table}.parquet'").fetchall()[0][0]
    if name == "op12_embedding_whitening":  # a row per vector and component
        assert rows.select("vec_id").distinct().count() == total and rows.count() == 32 * total
    else:
        assert name == "op7_license_scan" or rows.count() == total
