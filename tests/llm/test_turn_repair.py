"""op12 against all edit sequences of short conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from newsmill.llm import turn_repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, cells int, part int"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = VISIBLE.findall(text)
        out.append("b" if not marks else "d" if (role, text) in seen else "" if marks[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """All sequences: up to two inserts before each row and at the end."""
    inserts = [p for n in range(3) for p in itertools.product(["user", "assistant"], repeat=n)]
    best = (10**9, "", "")

    def go(i, cost, audit, done):
        nonlocal best
        if cost > best[0]:
            return
        for extra in inserts:
            c, a, d = cost + 2 * len(extra), audit + "I" * len(extra), done + [(r, "") for r in extra]
            if i == len(rows):
                if LEGAL.match("".join(r[:1] or "?" for r, _ in d)):
                    best = min(best, (c, a, "\n".join(f"{r}:{t}" for r, t in d)))
                continue
            role, text = rows[i]
            go(i + 1, c + 3, a + "D", d)
            if kinds[i] in ("b", "d"):
                continue
            more = kinds[i] == "t"
            go(i + 1, c + more, a + "K", d + [(role, text)])
            for other in ("user", "assistant"):
                go(i + 1, c + 2 + more, a + "R", d + [(other, text)])

    go(0, 0, "", [])
    return best


def plain(rows):
    """conv_id -> result, from the damaged rows in order."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        deal = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if deal == 0:
            continue
        if deal == 1:
            text = ""
        if deal == 2:
            text = re.sub("[.!?]", "", text)
        if deal == 4:
            role = "user"
        same = hashlib.sha256(f"{len(role)}\0{role}\0{text}".encode()).hexdigest()
        convs[conv] += [(turn is not None, turn or 0, role, same, text, turn)] * (2 if deal == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: r[:4])
        pairs = [(r[2], r[4]) for r in found]
        kinds = faults(pairs)
        turns = {r[5] for r in found} - {None}
        initials = [r[:1] for r, _ in pairs]
        cost, audit, text = cheapest(pairs, kinds)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            kinds.count("b"), kinds.count("d"), kinds.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(3)
    texts = ["Yes.", "No", "Why?", "", " \n", None, "So it is. ", "x" * 5, "é!", "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unit"]
    rows = []
    for conv in range(150):
        n = rng.randrange(1, 6)
        turns = [None if rng.random() < 0.1 else t + rng.randrange(2) * 3 for t in range(n)]
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi."), (None, 1, "assistant", "Hi."), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("stretch", [1, 256])
@pytest.mark.parametrize("parts", ["8", "97"])
def test_against_all_edits(spark, hard, parts, stretch, monkeypatch):
    monkeypatch.setattr(turn_repair, "STRETCH", stretch)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, 1, 2) for r in hard], SCHEMA).repartition(5)
        got = result(turn_repair.repair_damaged(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain(hard)
    assert got.keys() == want.keys()
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    kept = {r[0] for r in rows if r[1] < 6} - {r[0] for r in rows if r[1] >= 6}
    got, want = result(turn_repair.repair_damaged(df)), plain([r for r in rows if r[0] in kept])
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}
    assert got.keys() == {r[0] for r in rows}


def test_empty(spark):
    assert turn_repair.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversation_over_many_partitions(spark):
    """One conversation of 4,000 rows, among them one very long text, is cut and joined; the
    plain parse of the whole gives the same."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"t{t}.", ""])) for t in range(4000)]
    rows[100] = (7, 100, "user", "long. " * 400_000)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = result(turn_repair.repair(df))[7]
    kinds = faults([(r[2], r[3]) for r in rows])
    tops = {turn_repair.NONE: (0, "")}
    for (_, _, role, _), kind in zip(rows, kinds):
        tops = turn_repair.step(tops, role[:1], kind in ("b", "d"), kind == "t")
    cost, audit = turn_repair.accept(tops)
    assert (got[5], got[6]) == (cost, audit)
    done, at, place = [], 0, 0
    for edit in audit:
        if edit == "I":
            done.append(f"{('user', 'assistant')[place % 2]}:")
            place += 1
            continue
        role, text = rows[at][2:]
        at += 1
        if edit != "D":
            done.append(f"{role if edit == 'K' else ('user', 'assistant')[place % 2]}:{text}")
            place += not (edit == "K" and role == "system")
    assert got[7] == hashlib.sha256("\n".join(done).encode()).hexdigest()
