"""Toxicity of restored text: noisy-channel deobfuscation, then word evidence.

Every text is read as a sequence of observed characters. A word that may hide
letters (digits or symbols among letters, a letter three times or more in a
row, single letters set apart) becomes a lattice: each observed character
stands for itself or a letter it can be typed for, a repeat may be a repeat or
an echo, a gap between single letters may be a gap or filler. Viterbi picks
the likeliest path under a character language model of the whole corpus and
the channel's costs. All other words have one path and stay as they are.

The language model holds counts of folded character 4-grams of all rows. Their
number has a fixed bound (CODES ** ORDER cells), so the model is small at every
corpus size, while the counts grow with the corpus. The score comes from
the restored words and their prefixes: how many toxic and other labelled rows
have each, where rows with it in the same context, as copies are, count once.
A prefix counts once for each word that begins with it. Contexts are told apart
by a shuffle, first of the toxic rows, then of the other rows' contexts of the
words that toxic rows have. No word is left out for the size of the table.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ODD, SPACE_TABLE, buffers, chunks, column, fresh, known_labels, labelled, mix, signed, stage, word_hashes

ORDER = 4
CODES = 28  # a gap, a-z, anything else
PREFIXES = (4, 5, 6)
SUPPORT = 3  # toxic rows that a word needs
PRIOR = 6.0  # labelled rows that a word's evidence is weighed against
SENT = 1 << 20  # most words of a table that goes to the tasks; a larger one is joined
ECHO, FILLER, TYPED, SELF = 0.7, 0.4, 1.2, 3.0  # channel costs in nats: echo, filler, letter typed as a sign, sign meant as such

# The letters that a sign is typed for.
TYPED_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "¡": "i",
}

PIECE = 64  # characters after which the letters that all paths share are settled, or more while they share few
REMEMBERED = 256  # characters of a span whose decoding is kept for the next chunk


def _fold_table() -> np.ndarray:
    """Code of every character of the first planes' letters: 0 gap, 1-26 letters without accents, 27 others."""
    table = np.full(0x250, 27, np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFD", chr(c))[0].lower()
        if "a" <= base <= "z" and unicodedata.category(chr(c))[0] == "L":
            table[c] = ord(base) - 96
        elif chr(c).isspace():
            table[c] = 0
    return table


_FOLD = _fold_table()


def fold(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], 27).astype(np.uint8)


def _gram_counts(batches):
    """Counts of folded 4-grams of each task's rows."""
    counts = np.zeros(CODES**ORDER, np.int64)
    for batch in batches:
        texts = [t for t in batch.column("text").to_pylist() if t]
        for at in range(0, len(texts), 512):
            codes = np.concatenate([[0], fold("\n\n".join(texts[at : at + 512])), [0]]).astype(np.int32)
            codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one gap for many
            if len(codes) >= ORDER:
                grams = np.zeros(len(codes) - ORDER + 1, np.int32)
                for k in range(ORDER):
                    grams = grams * CODES + codes[k : len(codes) - ORDER + 1 + k]
                counts += np.bincount(grams, minlength=CODES**ORDER)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Cost in nats of a character after the three before it, from the counts
    of all rows of ``docs(text)``, interpolated over shorter contexts."""
    sums = docs.mapInArrow(_gram_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CODES**ORDER)
    counts[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    counts = counts.reshape([CODES] * ORDER)
    chance = np.full(CODES, 1 / CODES)
    for order in range(1, ORDER + 1):
        own = counts.sum(axis=tuple(range(ORDER - order)))
        chance = (own + 4 * chance) / (own.sum(axis=-1, keepdims=True) + 4)
    return -np.log(chance).astype(np.float32)


def _options(c: str) -> list[tuple[str, float]]:
    """What an observed character may stand for, with the channel's cost."""
    low = c.lower()
    if c in TYPED_FOR:
        return [(x, TYPED) for x in TYPED_FOR[c]] + [(c, SELF)]
    return [(low if len(low) == 1 else c, 0.0)]


def decode(span: str, costs: np.ndarray) -> str:
    """The likeliest text behind an observed span, by Viterbi over the lattice.

    One loop over the whole span. A state's text is a chain of letters back to
    what is settled; letters that all states share are settled from time to time.
    """
    states: dict[tuple, tuple[float, tuple | None, str]] = {(0, 0, 0): (0.0, None, "")}
    settled, due = [], PIECE
    for n, c in enumerate(span):
        if n == due:
            states, common, most = _settle(states)
            settled.append(common)
            due = n + max(PIECE, 2 * most)
        options = _options(c)
        gap = _filler(c)
        step: dict[tuple, tuple[float, tuple | None, str]] = {}

        def offer(key, cost, text, last):
            if key not in step or cost < step[key][0]:
                step[key] = (cost, text, last)

        for (x, y, z), (cost, text, last) in states.items():
            for letter, paid in options:
                code = int(_FOLD[ord(letter)]) if ord(letter) < len(_FOLD) else 27
                offer((y, z, code), cost + paid + float(costs[x, y, z, code]), (text, letter), letter)
                if letter == last and letter.isalpha():
                    offer((x, y, z), cost + paid + ECHO, text, last)
            if gap:
                offer((x, y, z), cost + FILLER, text, last)
        states = step
    best = min((cost + float(costs[x, y, z, 0]), _letters(text)) for (x, y, z), (cost, text, _) in states.items())
    return "".join([*settled, best[1]])


def _letters(text: tuple | None) -> str:
    """The letters of a state's chain."""
    out = []
    while text is not None:
        text, letter = text
        out.append(letter)
    return "".join(reversed(out))


def _settle(states: dict) -> tuple[dict, str, int]:
    """States without the start that all their texts share, that start, and the
    length of the longest rest. Costs count from the least, so they keep their digits."""
    texts = {key: _letters(text) for key, (_, text, _) in states.items()}
    common, least = os.path.commonprefix(list(texts.values())), min(cost for cost, _, _ in states.values())
    out = {}
    for key, (cost, _, last) in states.items():
        text = None
        for letter in texts[key][len(common) :]:
            text = (text, letter)
        out[key] = (cost - least, text, last)
    return out, common, max(map(len, texts.values())) - len(common)


def _filler(c: str) -> bool:
    """Whether a character may be set between letters to hide a word."""
    return not c.isalnum() and c not in TYPED_FOR or c == "*"


def decode_all(spans: list[str], costs: np.ndarray) -> list[str]:
    """``decode`` of many spans: short ones take each step of the loop together."""
    out = [decode(x, costs) if len(x) > PIECE else "" for x in spans]
    some = [i for i, x in enumerate(spans) if 0 < len(x) <= PIECE]
    if not some:
        return out
    sizes = np.array([len(spans[i]) for i in some])
    signs, ids = np.unique(np.frombuffer("".join(spans[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    options = [_options(chr(c)) for c in signs.tolist()]
    many = np.array([len(x) for x in options])
    at = np.cumsum(many) - many
    letters = np.array([ord(x) for each in options for x, _ in each], np.uint32)
    paid = np.array([cost for each in options for _, cost in each])
    alpha = np.array([x.isalpha() for each in options for x, _ in each])
    codes = np.where(letters < len(_FOLD), _FOLD[np.minimum(letters, len(_FOLD) - 1)], 27).astype(np.int64)
    filler = np.array([_filler(chr(c)) for c in signs.tolist()])
    table, cube = costs.reshape(-1).astype(np.float64), CODES ** (ORDER - 1)

    span, key, last, cost = np.arange(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), np.uint32), np.zeros(len(some))
    steps, ends = [], {}
    for n in range(int(sizes.max()) + 1):
        done = np.flatnonzero(sizes[span] == n)
        if len(done):
            order = done[np.lexsort((cost[done] + table[key[done] * CODES], span[done]))]
            order = order[np.concatenate([[True], span[order][1:] != span[order][:-1]])]
            ends[n] = (span[order], order)
        live = np.flatnonzero(sizes[span] > n)
        if not len(live):
            break
        sign = ids[begin[span[live]] + n]
        source = np.repeat(live, many[sign])
        which = np.repeat(at[sign] - np.cumsum(many[sign]) + many[sign], many[sign]) + np.arange(len(source))
        kept = np.flatnonzero((letters[which] == last[source]) & alpha[which])
        gaps = live[filler[sign]]
        parent = np.concatenate([source, source[kept], gaps])
        wrote = np.concatenate([letters[which], np.zeros(len(kept) + len(gaps), np.uint32)])
        keys = np.concatenate([key[source] * CODES % cube + codes[which], key[source[kept]], key[gaps]])
        total = np.concatenate([cost[source] + paid[which] + table[key[source] * CODES + codes[which]], cost[source[kept]] + paid[which[kept]] + ECHO, cost[gaps] + FILLER])
        place = span[parent] * cube + keys
        order = np.lexsort((total, place))
        order = order[np.concatenate([[True], place[order][1:] != place[order][:-1]])]
        parent, wrote = parent[order], wrote[order]
        steps.append((parent, wrote))
        span, key, last, cost = span[parent], keys[order], np.where(wrote > 0, wrote, last[parent]), total[order]
    text, state = np.zeros((len(some), int(sizes.max())), np.uint32), np.zeros(len(some), np.int64)
    going = np.zeros(0, np.int64)
    for n in range(int(sizes.max()), 0, -1):
        if n in ends:
            state[ends[n][0]] = ends[n][1]
            going = np.concatenate([going, ends[n][0]])
        parent, wrote = steps[n - 1]
        text[going, n - 1] = wrote[state[going]]
        state[going] = parent[state[going]]
    whole, stops = text[text > 0].tobytes().decode("utf-32-le", "surrogatepass"), np.cumsum((text > 0).sum(axis=1)).tolist()
    for i, a, b in zip(some, [0, *stops], stops):
        out[i] = whole[a:b]
    return out


def _classes() -> np.ndarray:
    """Of every byte: 1 letter (or part of one beyond ASCII), 2 digit, 3 sign typed for a letter, 4 other, 0 space."""
    kinds = np.full(256, 4, np.uint8)
    kinds[[32, *range(9, 14)]] = 0
    kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kinds[[ord(c) for c in TYPED_FOR if c.isascii()]] = 3
    kinds[48:58] = 2
    return kinds


_KINDS = _classes()


def suspects(data: np.ndarray, offsets: np.ndarray):
    """``(low, high, row)``: byte ranges that may hide letters.

    Between spaces and without the punctuation around it, a word is suspect if
    it has letters next to digits or typed signs, a letter twice in a row, or a separator inside. So are three or more
    single characters in a row, each set apart.
    """
    starts, ends, _, first = word_hashes(data, offsets, SPACE_TABLE)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    kinds = _KINDS[data]
    alnum = np.flatnonzero((kinds == 1) | (kinds == 2))
    left, right = np.searchsorted(alnum, starts), np.searchsorted(alnum, ends)
    full = left < right
    padded = np.append(alnum, len(data))
    low, high = np.where(full, padded[left], starts), np.where(full, padded[np.maximum(right, 1) - 1] + 1, starts)

    def within(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[high] - sums[low]

    for side, step, edge in ((low, -1, starts - 1), (high, 1, ends)):  # one @ or $ at an end may be a letter
        at = side - 1 if step < 0 else side
        room = full & (at * step < edge * step)
        at = np.where(room, at, 0)
        after = np.clip(at + step, 0, len(data) - 1)
        side += step * (room & ((data[at] == 36) | (data[at] == 64)) & ((data[after] != data[at]) | (at + step == edge)))
    letters, others = within(kinds == 1), within(kinds == 4)
    lower = data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
    twice = np.zeros(len(data), bool)
    twice[1:] = (lower[1:] == lower[:-1]) & (kinds[1:] == 1) & (data[1:] < 128)
    odd = full & (letters > 0) & ((within((kinds == 2) | (kinds == 3)) > 0) | (within(twice) > 0) | (others > 0))
    size = high - low
    single = full & ((size == 1) | ((size == 2) & (data[np.minimum(low, len(data) - 1)] >= 0xC0)))
    single |= (ends - starts == 1) & (kinds[starts] == 3)
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lows, highs, rows = [low[odd & ~single]], [high[odd & ~single]], [row[odd & ~single]]
    for a, b in zip(begin[stop - begin >= 3].tolist(), stop[stop - begin >= 3].tolist()):
        cuts = np.concatenate([[a], np.flatnonzero(np.diff(row[a:b])) + a + 1, [b]])
        for x, y in zip(cuts[:-1], cuts[1:]):
            if y - x >= 3:
                lows.append(starts[x : x + 1]), highs.append(ends[y - 1 : y]), rows.append(row[x : x + 1])
    low, high, row = np.concatenate(lows), np.concatenate(highs), np.concatenate(rows)
    order = np.argsort(low, kind="stable")
    return low[order], high[order], row[order]


def fragments(data: np.ndarray, offsets: np.ndarray):
    """``(low, high, row)``: two or more neighbouring words of at most three
    characters, which may be one word in pieces. They may overlap suspects."""
    starts, ends, _, first = word_hashes(data, offsets, SPACE_TABLE)
    sums = np.concatenate([[0], np.cumsum((data < 128) | (data >= 0xC0))])
    named = np.concatenate([[0], np.cumsum(_KINDS[data] == 1)])
    short = (sums[ends] - sums[starts] <= 3) & (named[ends] > named[starts])
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    tied = np.flatnonzero(short[1:] & short[:-1] & (row[1:] == row[:-1]))
    if not len(tied):
        return tied, tied, tied
    new = np.concatenate([[True], np.diff(tied) > 1])
    begin, stop = tied[new], tied[np.append(np.flatnonzero(new)[1:] - 1, len(tied) - 1)] + 1
    return starts[begin], ends[stop], row[begin]


_MEMO: dict[str, str] = {}


def _decoded(spans: list[bytes], costs: np.ndarray) -> list[str]:
    """What each span stands for; every distinct span is decoded once."""
    if len(_MEMO) > 1 << 17:
        _MEMO.clear()
    found: dict[bytes, str] = dict.fromkeys(spans, "")
    texts = {raw: raw.decode("utf-8", "replace") for raw in found}
    same = {raw for raw, span in texts.items() if len(set(span.lower()) - set(" .-_*/,\n\t\r")) == 1}  # one character over and over says nothing
    new = list({span for raw, span in texts.items() if raw not in same and span not in _MEMO})
    fresh = dict(zip(new, decode_all(new, costs)))
    for raw, span in texts.items():
        found[raw] = span if raw in same else fresh[span] if span in fresh else _MEMO[span]
    _MEMO.update((span, text) for span, text in fresh.items() if len(span) <= REMEMBERED)
    return [found[raw] for raw in spans]


def restore(text: str | None, costs: np.ndarray) -> str:
    """The text with every suspect span decoded. Null is empty."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    low, high, _ = suspects(data, np.array([0, len(raw)]))
    more, stop, _ = fragments(data, np.array([0, len(raw)]))
    apart = [k for k, (a, b) in enumerate(zip(more, stop)) if not ((low < b) & (high > a)).any()]
    low, high = np.sort(np.concatenate([low, more[apart]])), np.sort(np.concatenate([high, stop[apart]]))
    out, at = [], 0
    for a, b, found in zip(low.tolist(), high.tolist(), _decoded([raw[a:b] for a, b in zip(low, high)], costs)):
        out += [raw[at:a], found.encode()]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def _word_table() -> np.ndarray:
    """Bytes of words: ASCII letters (folded) and everything beyond ASCII."""
    table = mix((np.arange(256, dtype=np.uint64) + np.uint64(501)) * ODD)
    table[65:91] = table[97:123]
    table[[c for c in range(128) if not chr(c).isalpha()]] = 0
    return table


_WORDS = _word_table()


def _words_and_prefixes(data, offsets):
    """Hashes of words and prefixes, their rows, and contexts: of a word the
    word with its two neighbours, of a prefix the word."""
    starts, ends, words, first = word_hashes(data, offsets, _WORDS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    around = words * ODD
    if len(words) > 1:
        same = row[1:] == row[:-1]
        around[1:] += np.where(same, words[:-1], 1) * np.uint64(3)
        around[:-1] += np.where(same, words[1:], 2) * np.uint64(5)
    around = mix(around)
    parts, rows, contexts = [words], [row], [around]
    for size in PREFIXES:
        own = np.flatnonzero(ends - starts > size)
        total = np.zeros(len(own), np.uint64)
        for k in range(size):
            total = total * np.uint64(0xD6E8FEB86659FD93) + _WORDS[data[starts[own] + k]]
        parts.append(mix(total + np.uint64(size)))
        rows.append(row[own])
        contexts.append(words[own])  # a prefix stands for many words, so these are its witnesses
    whole = np.arange(sum(map(len, parts))) < len(words)
    return np.concatenate(parts), np.concatenate(rows), np.concatenate(contexts), whole


def evidence(data: np.ndarray, offsets: np.ndarray, costs: np.ndarray):
    """``(hashes, rows, contexts)``: words and prefixes of the restored texts.
    Suspect words count as they stand, too."""
    hashes, rows, contexts, _ = _words_and_prefixes(data, offsets)
    low, high, row = (np.concatenate(x) for x in zip(suspects(data, offsets), fragments(data, offsets)))
    if len(low):
        more, own, around, whole = _words_and_prefixes(*buffers(pa.array(_decoded([data[a:b].tobytes() for a, b in zip(low, high)], costs), pa.string())))
        before = np.array([zlib.crc32(data[max(a - 12, 0) : a].tobytes()) for a in low.tolist()], np.uint64)
        after = np.array([zlib.crc32(data[b : b + 12].tobytes()) for b in high.tolist()], np.uint64)
        around = np.where(whole, mix(around + (before << np.uint64(32) | after)[own]), around)
        hashes, rows, contexts = np.concatenate([hashes, more]), np.concatenate([rows, row[own]]), np.concatenate([contexts, around])
    return hashes, rows, contexts


def _of_model(features: np.ndarray, hashes: np.ndarray):
    """``(which, place)``: the hashes that the model has, and where it has them."""
    low = np.uint64((1 << max(20, len(features).bit_length() + 3)) - 1)
    flags = np.zeros(int(low) + 1, bool)
    flags[features & low] = True
    which = np.flatnonzero(flags[hashes & low])
    if not len(features):
        return which, which
    place = np.minimum(np.searchsorted(features, hashes[which]), len(features) - 1)
    good = features[place] == hashes[which]
    return which[good], place[good]


def _contexts(batches, costs, features=None):
    """``(feature, context, n)`` of each chunk: contexts of a word, of those in
    ``features`` if given, and how many rows have it there."""
    for _, data, offsets in chunks(batches, "text"):
        hashes, rows, contexts = evidence(data, offsets, costs)
        if features is not None:
            which, _ = _of_model(features, hashes)
            hashes, rows, contexts = hashes[which], rows[which], contexts[which]
        order = np.lexsort((contexts, hashes, rows))  # a row is one witness: its least context
        hashes, rows, contexts = hashes[order], rows[order], contexts[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, contexts = hashes[new], contexts[new]
        order = np.lexsort((contexts, hashes))
        hashes, contexts = hashes[order], contexts[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (contexts[1:] != contexts[:-1])
        n = np.diff(np.append(np.flatnonzero(new), len(hashes)))
        yield pa.RecordBatch.from_arrays([signed(hashes[new]), signed(contexts[new]), pa.array(n, pa.int64())], ["feature", "context", "n"])


def _sent(words: DataFrame) -> pa.Table | None:
    """The table if it is small enough to go to every task."""
    table = words.limit(SENT + 1).toArrow()
    return table if table.num_rows <= SENT else None


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """``(costs, words)`` from ``docs(id, text)`` and the labels to learn from;
    ``words(feature, chance)`` is stored."""
    costs = language_model(docs.select("text"))
    rows = labelled(docs, labels)
    kinds = "feature long, context long, n long"
    # Copies of a text and repeats within it are one witness: only different contexts count.
    toxic = rows.where("label = 1").select("text").mapInArrow(partial(_contexts, costs=costs), kinds)
    toxic = toxic.groupBy("feature", "context").agg(F.sum("n").alias("n")).groupBy("feature").agg(F.count("*").alias("bad"), F.sum("n").alias("n"))
    candidates = stage(toxic.where(F.col("n") >= SUPPORT).select("feature", "bad"), "candidates")
    table = _sent(candidates.select("feature"))
    features = None if table is None else np.sort(table.column("feature").to_numpy().view(np.uint64))
    others = rows.where("label = 0").select("text").mapInArrow(partial(_contexts, costs=costs, features=features), kinds).select("feature", "context")
    if features is None:
        others = others.join(candidates, "feature", "left_semi")
    fine = others.distinct().groupBy("feature").agg(F.count("*").alias("fine"))
    votes = candidates.join(fine, "feature", "left").select("feature", "bad", F.coalesce("fine", F.lit(0)).alias("fine"))
    words = votes.where(F.col("bad") * 3 > F.col("fine")).select("feature", (F.col("bad") / (F.col("bad") + F.col("fine") + PRIOR)).alias("chance"))
    return costs, stage(words, "words")


def _model(costs: np.ndarray, words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``(costs, features, chances)`` to send, or None if the words are too many."""
    table = _sent(words)
    if table is None:
        return None
    features, chances = table.column("feature").to_numpy().view(np.uint64), table.column("chance").to_numpy()
    order = np.argsort(features)
    return costs, features[order], chances[order]


def _row_words(batches, costs):
    """The distinct words of each row."""
    for batch, data, offsets in chunks(batches, "text"):
        hashes, rows, _ = evidence(data, offsets, costs)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(rows[new])), signed(hashes[new])], ["_row", "feature"])


def _joined(docs: DataFrame, text_col: str, costs: np.ndarray, words: DataFrame) -> DataFrame:
    """``docs`` and a last column, the score, where the words are too many to
    send: their table meets the rows' words in a join. The rows are stored to
    keep their numbers."""
    row, other, score = fresh(docs, "_row", "_other", "_score")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = rows.select(F.col(row).alias("_row"), F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_row_words, costs=costs), "_row long, feature long")
    best = found.join(words, "feature").groupBy("_row").agg(F.max("chance").alias(score)).withColumnRenamed("_row", other)
    scored = rows.join(best, F.col(row) == F.col(other), "left")
    return scored.select(*map(column, docs.columns), F.coalesce(score, F.lit(0.0)).alias(score))


def _best(data, offsets, costs, features, chances) -> np.ndarray:
    hashes, rows, _ = evidence(data, offsets, costs)
    which, place = _of_model(features, hashes)
    best = np.zeros(len(offsets) - 1)
    np.maximum.at(best, rows[which], chances[place])
    return best


def _scores(batches, model):
    for batch, data, offsets in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_best(data, offsets, *model))], ["id", "score"])


def _clean(batches, text_col, threshold, model):
    for batch, data, offsets in chunks(batches, text_col):
        yield batch.filter(pa.array(_best(data, offsets, *model) < threshold))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``; null
    and empty texts stay. One pass over the rows, without a join unless the
    model has over SENT words."""
    trained = train(_id_text(docs, id_col, text_col), known_labels(labels, id_col, label_col))
    model = _model(*trained)
    if model is None:
        scored = _joined(docs, text_col, *trained)
        return scored.where(F.col(scored.columns[-1]) < threshold).select(*map(column, docs.columns))
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # mapInArrow takes no names with dots
    clean = partial(_clean, text_col=plain.columns[docs.columns.index(text_col)], threshold=threshold, model=model)
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)


def _id_text(docs, id_col, text_col):
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id, score)`` per row: the chance that a row with its most telling
    restored word is toxic, 0 for null and empty texts and without labels.

    Rows with one id are separate rows. Other columns are ignored.
    """
    docs = _id_text(docs, id_col, text_col)
    trained = train(docs, known_labels(labels, id_col, label_col))
    model = _model(*trained)
    if model is None:
        return _joined(docs, "text", *trained).select(F.col("id").alias(id_col), F.col("_score").alias("score"))
    return docs.mapInArrow(partial(_scores, model=model), "id long, score double").withColumnRenamed("id", id_col)


def restored(docs: DataFrame, costs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, restored)``: the decoded text of every row, for inspection."""

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: restore(t, costs))

    return docs.select(id_col, decoded(F.col(text_col).cast("string")).alias("restored"))
