"""Repeated word windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import substring_dedup
from docloom.llm.common import buffers
from docloom.llm.substring_dedup import WORDS, packed_words, remove_repeated_words, sort_windows, super_kmers
from tests.llm.test_pairs import edge_rows, frame, prose

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [SPACE_WORDS.findall(text or "") for _, text in rows]
    least = {}
    for (id, _), own in zip(rows, words):
        for k in range(len(own) - WORDS + 1):
            if id is not None:
                w = tuple(own[k : k + WORDS])
                least[w] = min(least.get(w, id), id)
    out = []
    for (id, _), own in zip(rows, words):
        gone = set()
        for k in range(len(own) - WORDS + 1):
            if id is not None and least[tuple(own[k : k + WORDS])] < id:
                gone.update(range(k, k + WORDS))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((id, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def ours(spark, rows, **columns):
    return sorted((tuple(r) for r in remove_repeated_words(frame(spark, rows)).collect()), key=repr)


def mixed_rows(seed=3):
    """Copies with other spaces, overlapping passages, repeats inside a text, passages at both ends."""
    rng = random.Random(seed)
    passages = [prose(rng, n, 500).split() for n in (12, 13, 14, 40, 60)]
    rows = []
    for id in rng.sample(range(200), 60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += prose(rng, rng.randrange(0, 30), 3000).split()
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            words += p[a:] if rng.random() < 0.3 else p
        rows.append((id, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


def test_equal_to_brute_force(spark):
    rows = edge_rows() + mixed_rows()
    assert ours(spark, rows) == brute(rows)


def test_buckets_that_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LIMIT", 1)
    rows = mixed_rows(4) + [(None, prose(random.Random(1), 40)), (500, prose(random.Random(1), 40)), (501, prose(random.Random(1), 40))]
    assert ours(spark, rows) == brute(rows)


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    long = prose(rng, 3000, 50000)
    words = long.split()
    rows = [(1, long), (2, " ".join(words[100:900]) + " new " + " ".join(words[905:])), (3, "x" * 9000 + " " + " ".join(words[1000:1020]))]
    expected = brute(rows)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "_BLOCK", 50)
    data, offsets = buffers(pa.array([long]))
    whole = super_kmers(substring_dedup._long_words(data), np.array([0, 3000]))
    parts = [super_kmers(w, f) + (base,) for base, w, f in substring_dedup._parts(data, offsets)]
    windows = lambda g, at, size: {(h, a + k) for h, a, n in zip(g.tolist(), at.tolist(), size.tolist()) for k in range(n)}
    assert set().union(*(windows(g, at + base, size) for g, _, at, size, base in parts)) == windows(whole[0], whole[2], whole[3])
    assert ours(spark, rows) == expected


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_packed_words_of_touching_rows():
    data, offsets = buffers(pa.array(["ab c", "", "d", None, "é ", "f"]))
    packed, place, first = packed_words(data, offsets)
    assert packed.tobytes().decode() == "ab c d é f "
    assert first.tolist() == [0, 2, 2, 3, 3, 4, 5] and place.tolist() == [0, 3, 5, 7, 10, 12]


@pytest.mark.parametrize("seed", range(3))
def test_equal_windows_share_a_minimiser(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    twice = np.concatenate([words, words[50:90], rng.integers(0, 1 << 62, 30).astype(np.uint64)])
    g, _, at, size = super_kmers(twice, np.array([0, len(twice)]))
    of = {a + k: h for h, a, n in zip(g.tolist(), at.tolist(), size.tolist()) for k in range(n)}
    assert len(of) == len(twice) - WORDS + 1 and size.max() <= WORDS - substring_dedup.GRAM + 1
    assert all(of[50 + k] == of[400 + k] for k in range(40 - WORDS + 1))


def test_sort_windows():
    a = b" ".join(b"%d" % k for k in range(15))
    b = b" ".join(b"%d" % k for k in range(1, 16))
    assert sort_windows([a, b], [7, 3]) == [[7, 3, 3], [3, 3, 3]]
