"""Near duplicates, repeated passages, decontamination, line dedup and licenses against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, license_scan, line_dedup, near_dedup, suffix_dedup
from docloom.llm.common import ALNUM_TABLE, SPACE_TABLE, chunks, word_hashes

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, key string, node string, rows int, c long, id string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def frame(spark, rows):
    """Documents with columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "k", None, 3, None, "x") for i, t in rows], SCHEMA)


def edge_rows():
    """Nulls, empty and blank texts, ties, repeated ids and rows, a very long text."""
    rng = random.Random(5)
    base, long = prose(rng, 160, 4000), prose(rng, 30000, 50000)
    near = base.split()
    near[80] = "changed"
    passage = prose(rng, 150, 9000)
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One two"),
        (9, base), (9, base), (None, base), (None, None), (10, long), (11, long[:9000] + " tail " + passage), (12, "head " + passage + " end"),
        (12, "another text of id twelve with a few words"), (13, "a a a a a a a a a a"), (14, "é" * 500), (15, "é" * 500), (16, "x" * 399), (17, "x" * 399), (18, "y" * 1000),
    ]


def brute_components(rows, percent=75):
    sets = []
    for _, text in rows:
        words = SPACE_WORDS.findall((text or "").translate(LOW))
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = (min(least[find(k)]) if least[find(k)] else None) if sets[k] else i
        out.append((i, len(sets[k]), component, component is None or i == component))
    return Counter(out)


def components_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_duplicates_edge_cases(spark):
    rows = edge_rows()
    assert components_of(near_dedup.near_duplicates(frame(spark, rows))) == brute_components(rows)


def test_near_duplicates_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("small, block", [(16, 2048), (2, 3)])
def test_near_duplicates_of_drifting_copies(spark, monkeypatch, small, block):
    """A group of copies that drift apart, with every way of handling large keys."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(7)
    base = prose(rng, 120, 100000).split()
    rows = [(i, prose(rng, rng.randrange(1, 60), 30)) for i in range(100, 140)]
    for i in range(60):
        words = list(base)
        for place in rng.sample(range(120), rng.randrange(0, 8)):
            words[place] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert components_of(near_dedup.near_duplicates(frame(spark, rows))) == brute_components(rows)


def brute_removal(rows, least=400):
    count = Counter()
    for _, text in rows:
        data = (text or "").encode()
        count.update(data[k : k + least] for k in range(len(data) - least + 1))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - least + 1):
            if count[data[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return Counter(out)


def removal_of(df):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
    return Counter((*tuple(r)[:5], bytes(r.kept_bytes)) for r in df.select(columns).collect())


@pytest.mark.parametrize("limit", [512, 1])
def test_suffix_dedup(spark, monkeypatch, limit):
    """Also where every group is cut into cells and windows."""
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    rng = random.Random(3)
    rows = edge_rows()
    passages = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (399, 400, 401, 900)]
    for i in range(40, 70):
        left, right = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(300))) for _ in range(2))
        rows.append((i, left + passages[i % 4] + right + passages[(i + 1) % 4][: rng.randrange(300, 900)]))
    assert removal_of(suffix_dedup.remove_repeats(frame(spark, rows))) == brute_removal(rows)


def test_suffix_dedup_planted_passages(spark):
    """Passages of over 50 words in two documents: 400 bytes go whole, fewer stay."""
    rng = random.Random(13)
    rows, gone = [], {}
    for k, n in enumerate(range(51, 111, 3)):
        passage = prose(rng, n, 4000)
        for i in (2 * k, 2 * k + 1):  # the bytes beside the passage differ
            rows.append((i, f"{prose(rng, rng.randrange(20, 200), 10**6)} {i % 2}{passage}{i % 2} {prose(rng, 50, 10**6)}"))
            gone[i] = len(passage) if len(passage) >= 400 else 0
    for i in range(100, 140):
        rows.append((i, prose(rng, rng.randrange(60, 400), 10**6)))
        gone[i] = 0
    found = suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_removed").collect()
    assert 0 < sum(n > 0 for n in gone.values()) < 40
    assert dict(map(tuple, found)) == gone


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.remove_repeats(frame(spark, []).where("false")).collect() == []


def test_maximal_repeats_are_maximal_and_complete():
    rng = random.Random(1)
    for _ in range(30):
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(8, 30))).encode() for _ in range(4)]
        text = b"".join(p + bytes([1 + k]) for k, p in enumerate(pieces))
        want = set()
        for n in range(5, 30):
            places = defaultdict(list)
            for k in range(len(text) - n + 1):
                if min(text[k : k + n]) > 9:
                    places[text[k : k + n]].append(k)
            for s, at in places.items():
                left = {(text[k - 1] if k and text[k - 1] > 9 else -k - 1) for k in at}
                right = {(text[k + n] if text[k + n] > 9 else -k - 1) for k in at}
                if len(at) > 1 and len(left) > 1 and len(right) > 1:
                    want.add((n, tuple(at)))
        got = {(n, tuple(sorted(at.tolist()))) for n, at in suffix_dedup.maximal_repeats(pieces, 5)}
        assert got == want


def brute_hits(rows, items, window=10):
    known = defaultdict(set)
    for item, text in items:
        words = ALNUM_WORDS.findall((text or "").translate(LOW))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            known[tuple(words[k : k + size])].add(item)
    out = []
    for i, text in rows:
        words, hit, found = ALNUM_WORDS.findall((text or "").translate(LOW)), set(), set()
        for size in {len(x) for x in known}:
            for k in range(len(words) - size + 1):
                if words and tuple(words[k : k + size]) in known:
                    hit.update(range(k, k + size))
                    found |= known[tuple(words[k : k + size])]
        out.append((i, len(words), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


@pytest.mark.parametrize("block, vocabulary", [(1 << 18, 1 << 20), (20, 1 << 20), (1 << 18, 1)])
def test_decontamination(spark, monkeypatch, block, vocabulary):
    """Also with the test set in several blocks, and with an index of all terms."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "VOCABULARY", vocabulary)
    rng = random.Random(9)
    words = prose(rng, 300, 40).split()
    items = [(1, " ".join(words[:14])), (2, "w1 W2"), (3, ""), (4, None), (None, "w5 w6 w7"), (10, " ".join(words[50:60])), (11, " ".join(words[50:60])), (12, "é-à!")]
    rows = [(i, prose(rng, 80, 40) + " " + " ".join(words[rng.randrange(60) :][: rng.randrange(30)])) for i in range(30)] + edge_rows() + [(99, "É é à"), (98, "x é, à")]
    got = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == brute_hits(rows, items)


def test_decontamination_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.contamination(docs, items).collect()] == [(1, 2, 0)]
    assert decontaminate.contamination(docs.where("false"), items).collect() == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a y c"), (2, "a b q q q q c"), (3, "c b a"), (4, "a b")], "id long, text string")
    index = decontaminate.build_index(docs)
    items = spark.createDataFrame([("p", "a b c")], "item string, text string")
    rows = index.where("row IS NOT NULL").select("shard", "row", "id")
    found = decontaminate.find_matches(index, items, slack=2).join(rows, ["shard", "row"])
    assert sorted((r.id, r.low, r.high) for r in found.collect()) == [(1, 0, 5), (3, 0, 3)]
    exact = decontaminate.find_matches(index, items).join(rows, ["shard", "row"])
    assert exact.collect() == []


def brute_lines(rows):
    """Windows of two lines with words, or a line of 50 words, that stand earlier."""
    seen, gone, order = set(), defaultdict(set), []
    for at, (i, text) in enumerate(rows):
        if text is not None:
            order.append((i is not None, i or 0, at))
    texts = {}
    for _, _, at in sorted(order):
        i, text = rows[at]
        if (i, text) in texts:
            gone[at] = gone[texts[i, text]]
            continue
        texts[i, text] = at
        units = [(k, line) for k, line in enumerate(text.split("\n")) if SPACE_WORDS.search(line)]
        windows = [(k, (line,), [k]) for k, line in units if len(SPACE_WORDS.findall(line)) >= 50]
        windows += [(k, (line, after), [k, n]) for (k, line), (n, after) in zip(units, units[1:])]
        for _, window, lines in sorted(windows):
            if window in seen:
                gone[at].update(lines)
            seen.add(window)
    return Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[at]), len(gone[at])) for at, (i, t) in enumerate(rows))


def test_line_dedup(spark):
    rng = random.Random(2)
    lines = [prose(rng, rng.choice([1, 3, 60]), 50) for _ in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same\nsame\nsame\nsame"), (103, "a\n\nb"), (104, "b\na\nb\n\n"), (105, "\n".join(lines * 60)), (None, "a\nb\nnew"), (106, rows[3][1]), (3, rows[3][1])]
    got = line_dedup.deduplicate_lines(frame(spark, rows).withColumn("n_runs", F.lit("old")))
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute_lines(rows)
    assert {"key", "node", "c", "id", "rows"} < set(got.columns)


def test_line_dedup_empty_table(spark):
    assert line_dedup.deduplicate_lines(frame(spark, []).where("false")).collect() == []


def brute_licenses(rows, templates):
    out = set()
    for i, text in rows:
        words = ALNUM_WORDS.findall((text or "").translate(LOW))
        for name, notice in templates.items():
            own = ALNUM_WORDS.findall(notice.translate(LOW))
            if not own:
                continue
            size, step = min(5, len(own)), max(1, len(own) // 4)
            wanted = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
            reach = -(-(len(own) - size + 1 + step) // step) * step
            grams = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
            shares = [len(set(grams[k : k + reach]) & wanted) / len(wanted) for k in range(0, len(grams), step)]
            if shares and max(shares) >= 0.75:
                out.add((i, name, max(shares)))
    return out


def test_license_scan(spark):
    rng = random.Random(4)
    rows = edge_rows()
    notices = dict(license_scan.TEMPLATES, short="Two words", none="!!", empty="")
    for i, notice in enumerate(list(notices.values()) * 6):
        words = notice.split()
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), "inserted")
        rows.append((200 + i, prose(rng, rng.randrange(60)) + " " + " ".join(words).upper() + " " + prose(rng, 20)))
    want = brute_licenses(rows, notices)
    for templates in (notices, spark.createDataFrame(list(notices.items()), "name string, text string")):
        got = license_scan.scan_licenses(frame(spark, rows), templates)
        assert {(r.doc_id, r.license, r.containment) for r in got.collect()} == want
    assert license_scan.scan_licenses(frame(spark, rows).where("false")).collect() == []


def test_license_tables_are_checked(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "TEMPLATE_WORDS", 3)
    with pytest.raises(ValueError):
        license_scan.scan_licenses(frame(spark, [(1, "a")]), spark.createDataFrame([("n", "a b c d")], "name string, text string"))


def test_words_of_chunks():
    rng = random.Random(6)
    rows = ["".join(rng.choice("ab AB\n1é.") for _ in range(rng.randrange(12))) for _ in range(2000)] + [None, "", " ", " a"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows)})
    for table, pattern in ((SPACE_TABLE, SPACE_WORDS), (ALNUM_TABLE, ALNUM_WORDS)):
        seen, at = {}, 0
        for part, data, offsets in chunks([batch], "text", 500):
            starts, ends, hashes, first = word_hashes(data, offsets, table)
            for r in range(part.num_rows):
                own = slice(first[r], first[r + 1])
                words = [bytes(data[a:b]).decode().translate(LOW) for a, b in zip(starts[own], ends[own])]
                assert words == pattern.findall((rows[at] or "").translate(LOW))
                assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes[own]))
                at += 1
        assert at == len(rows) and len(set(seen.values())) == len(seen)
