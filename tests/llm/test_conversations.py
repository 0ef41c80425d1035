"""Conversation repair against enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from docloom.llm import conversation_repair
from docloom.llm.conversation_repair import damage, derive, derive_long, goal, repair_conversations, repair_report
from docloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, audit int, facts string"
LAW = re.compile(r"(s?(ua)+)?\Z")
SPACES = " \t\n\x0b\f\r"


def enumerate_edits(kinds, most=2):
    """All edits of a few rows, with up to ``most`` insertions in each gap."""
    per_row = []
    for kind in kinds:
        options = [(2, "D", "")]
        if kind != "D":
            cut = 5 if kind.isupper() else 0
            options += [(cut, "K", kind.lower()), (cut + 1, "R", "u"), (cut + 1, "R", "a")]
        per_row.append(options)
    gaps = [(5 * n, "I" * n, "".join(r)) for n in range(most + 1) for r in itertools.product("ua", repeat=n)]
    best = None
    for rows in itertools.product(*per_row):
        for between in itertools.product(gaps, repeat=len(kinds) + 1):
            parts = [between[0]] + [x for pair in zip(rows, between[1:]) for x in pair]
            if LAW.match("".join(p[2] for p in parts)):
                value = sum(p[0] for p in parts), "".join(p[1] for p in parts)
                best = value if best is None or value < best else best
    return best


def step_by_step(kinds):
    """Best value per state after each row, by relaxing until nothing changes."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "")}

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value
            return True

    def insertions(table):
        changed = True
        while changed:
            changed = False
            for (q, r), to in step.items():
                if r != "s" and q in table and better(table, to, (table[q][0] + 5, table[q][1] + "I")):
                    changed = True

    insertions(best)
    for kind in kinds:
        then = {}
        for q, (cost, audit) in best.items():
            better(then, q, (cost + 2, audit + "D"))
            if kind != "D":
                cut = 5 if kind.isupper() else 0
                if (q, kind.lower()) in step:
                    better(then, step[q, kind.lower()], (cost + cut, audit + "K"))
                for r in "ua":
                    if (q, r) in step:
                        better(then, step[q, r], (cost + cut + 1, audit + "R"))
        best = then
        insertions(best)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows, originals):
    """Expected report of rows (conv_id, turn, role, text)."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        of[c].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), turn, text))
    out = []
    for c in originals:
        own = sorted(of[c], key=lambda r: r[:3])
        seen, kinds, faults = set(), "", [0, 0, 0]
        for _, role, _, _, text in own:
            last = text.rstrip(SPACES)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            kinds += "D" if fault in (0, 1) else letter.upper() if fault == 2 else letter
        turns = [r[3] for r in own if r[3] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = step_by_step(kinds)
        lines, left = [], iter(own)
        for edit in audit:
            after = lines[-1][:1] if lines else ""
            wanted = "assistant" if after == "u" else "user"
            row = None if edit == "I" else next(left)
            if edit == "K":
                lines.append(f"{row[1]}:{row[4]}")
            elif edit == "R":
                lines.append(f"{wanted}:{row[4]}")
            elif edit == "I":
                lines.append(f"{wanted}:")
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 4, None) for r in rows], SCHEMA)


def report(df):
    columns = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", range(4))
def test_derivations_are_lightest(size):
    rng = random.Random(size)
    shapes = ["".join(x) for x in itertools.product("suaxSUAXD", repeat=size)]
    for kinds in shapes if size < 3 else rng.sample(shapes, 25):
        assert goal(derive(kinds)) == enumerate_edits(kinds) == step_by_step(kinds)


@pytest.mark.parametrize("seed", range(20))
def test_blocks_joined_give_the_same(seed, monkeypatch):
    rng = random.Random(seed)
    kinds = "".join(rng.choices("suaxUAD", [1, 8, 8, 1, 2, 2, 3], k=rng.randrange(1, 60)))
    monkeypatch.setattr(conversation_repair, "BLOCK", rng.choice([1, 2, 5, 7]))
    assert goal(derive_long(kinds)) == goal(derive(kinds)) == step_by_step(kinds)


def rows_of(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), conversations):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            role = rng.choice(["system", "tool", "", None, "userbot"]) if rng.random() < 0.15 else role
            text = rng.choice(["Yes.", "No!", "Why?\n", " \t", "", "cut off", "a. b ", None, "été", "Same again."])
            turn = rng.choice([None, turn, turn * 3, turn])
            rows.append((c if c % 50 else None, turn, role, text))
    return rows + rows[:5] + [(5000, None, "user", "One."), (5000, None, "user", "One."), (5001, -4, "user", "Hi."), (5001, 2**40, "assistant", "Ho.")]


def test_report_equals_brute_force(spark):
    rows = rows_of(1)
    originals = {r[0] for r in rows} | {7777}
    found = repair_report(frame(spark, rows), frame(spark, [*rows, (7777, 1, "user", "x")]))
    assert report(found) == brute(rows, originals)


def test_long_conversation_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"Number {t}.", f"open {t}"])) for t in range(3000)]
    rows += [(2, t, ["user", "assistant"][t % 2], "x" * 100_000 + f"{t}.") for t in range(4)]
    rng.shuffle(rows)
    assert report(repair_report(frame(spark, rows).repartition(5))) == brute(rows, {1, 2})


def test_repaired_rows_follow_the_audit(spark):
    rows = rows_of(3)
    lines = defaultdict(list)
    for r in sorted(repair_conversations(frame(spark, rows)).collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    for c, *_, audit, digest in report(repair_report(frame(spark, rows))):
        own = lines[c]
        assert "".join(e for e, _, _ in own) == audit.replace("D", "")
        assert LAW.match("".join(role[:1] for _, role, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == digest


def test_empty_table(spark):
    assert report(repair_report(frame(spark, []))) == [] and repair_conversations(frame(spark, [])).collect() == []


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        die = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if die:
            text = "" if die == 1 else re.sub("[.!?]", "", text) if die == 2 else text
            out += [(c, turn, "user" if die == 4 else role, text)] * (2 if die == 3 else 1)
    return out


def test_damage(spark):
    rows = rows_of(5, 100)
    found = sorted((tuple(r) for r in damage(frame(spark, rows)).collect()), key=repr)
    assert found == sorted(damaged(rows), key=repr)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(QUERIES["op13_conversation_repair"](spark, sf)) == brute(damaged(rows), {r[0] for r in rows})
