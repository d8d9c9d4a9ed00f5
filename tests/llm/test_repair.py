import hashlib
import itertools
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import assert_same, connection
from tidewheel.llm import queries, repair

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost double"


def solve_slowly(rows):
    """All ways by breadth: costs of (row, initials so far) with the least audits, insertions at most two in a row."""
    best = {}

    def walk(i, initials, cost, audit, turns, run):
        if cost > limit:
            return
        if i == len(rows) and LEGAL.fullmatch(initials):
            best.setdefault((cost, audit), turns)
        if i < len(rows):
            role, text, fault = rows[i]
            walk(i + 1, initials, cost + 3, audit + "D", turns, 0)
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                for letter, r, c in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    now = initials + (r[:1] or "?")
                    if begins(now):
                        walk(i + 1, now, cost + c + extra, audit + letter, (*turns, (r, text)), 0)
        if run < 3:
            for r in ("user", "assistant"):
                if begins(initials + r[0]):
                    walk(i, initials + r[0], cost + 2, audit + "I", (*turns, (r, "")), run + 1)

    limit = 3 * len(rows)
    walk(0, "", 0, "", (), 0)
    cost, audit = min(best)
    return cost, audit, best[cost, audit]


def begins(initials):
    return any(LEGAL.fullmatch(initials + end) for end in ("", "a", "ua"))


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def slow(table):
    """Every column of the contract, per conversation, from rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faulty = faults([r[1:] for r in rows])
        turns = [t for t, _, _ in rows if t is not None]
        number = [sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, fixed = solve_slowly(faulty)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *number, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)


ROLES = ("system", "user", "assistant", "user", "assistant", "tool", None, "", "user")
TEXTS = ("Fine.", "Is it?", "cut of", "", None, " \n", "Fine.", "So. ", "yes!")


def test_equals_brute_force(spark):
    rows = [(c, t, ROLES[(c * 5 + t * 3) % 9] if c % 3 else ("user", "assistant")[t % 2], TEXTS[(c * 7 + t * (c % 4 + 1)) % 9]) for c in range(90) for t in range(c % 6)]
    rows += [(1000, None, "user", "Hi."), (1000, None, "user", "Hi."), (1000, 3, "assistant", "Ho."), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (1001, 9, "assistant", "x."), (1001, 9, "assistant", "y.")]
    rows += rows[:4]
    found = repair.audits(make(spark, rows))
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == slow(rows)
    assert {c for c, *_ in rows} == {r["conv_id"] for r in found.collect()}
    assert repair.audits(make(spark, rows).where(F.lit(False))).count() == 0


SYMBOLS = {"x": ("user", "", "blank")} | {c: (w, "t.", None) for c, w in (("s", "system"), ("u", "user"), ("a", "assistant"), ("o", "tool"))}
SYMBOLS |= {c.upper(): (w, "t", "truncated") for c, (w, _, f) in SYMBOLS.items() if f is None}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="xsuaoSUAO", max_size=6))
def test_least_cost_and_least_audit(signature):
    cost, audit, _ = solve_slowly([SYMBOLS[c] for c in signature])
    assert repair.solve(signature) == (cost, audit)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="xsuaoSUAO", max_size=300), st.integers(1, 20))
def test_long_audits_cost_what_they_say_and_make_legal_turns(piece, times):
    signature = piece * times
    cost, audit = repair.solve(signature)
    rows, state, spent, initials = iter(signature), repair.START, 0, ""
    for letter in audit:
        row = "" if letter == "I" else next(rows)
        spent += {"K": 0, "R": 2, "D": 3, "I": 2}[letter] + (letter in "KR" and row.isupper())
        if letter != "D":
            state = repair.KEEPS[row.lower()][state] if letter == "K" else repair.NEXT[state]
            initials += " sua"[state]
    assert next(rows, None) is None and spent == cost and LEGAL.fullmatch(initials)


def test_long_conversations_take_linear_time(spark):
    begin = time.process_time()
    assert repair.solve("ua" * 200_000)[0] == 0
    assert repair.solve("".join("suaxAUo"[i * i % 97 % 7] for i in range(200_000)))[0] > 0
    assert time.process_time() - begin < 20
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(30_000)] + [(2, 0, "user", "Hi.")]
    found = {r["conv_id"]: r for r in repair.audits(make(spark, rows)).collect()}
    assert len(found) == 2 and len(found[1]["audit"]) > 28_000 and found[1]["gaps"] > 0


def test_repaired_turns(spark):
    rows = [(7, t, r, x) for t, r, x in ((0, "assistant", "Hello."), (1, "user", "Well?"), (2, "user", "So?"), (3, "assistant", "Yes."))]
    table = make(spark, rows)
    turns = [r for r in repair.repair(table).collect() if r["head"] is None]
    assert LEGAL.fullmatch("".join(r["role"][0] for r in turns)) and [r["place"] for r in turns] == list(range(1, len(turns) + 1))
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turns)
    assert repair.audits(table).first()["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_hot_signatures_and_conversations_of_one_row(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t], f"text {c}.") for c in range(300) for t in range(2)]
    want = sorted(repair.audits(make(spark, rows)).collect())
    monkeypatch.setattr(repair, "LIGHT", 0)  # all signatures in the shuffle
    assert sorted(repair.audits(make(spark, rows)).collect()) == want


def test_equals_sql(spark, sf_dir):
    assert_same(queries.op13_conversations(spark, sf_dir), connection(sf_dir), queries.ORACLES["op13_conversations"])
