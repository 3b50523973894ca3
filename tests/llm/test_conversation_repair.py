"""Conversation repair against plain programs: all edit scripts of short conversations, a table for longer ones."""

import hashlib
import itertools
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, seq string"
SPACE = " \t\n\x0b\x0c\r"
INSERTS = {0: [("", 0), ("I", 2), ("II", 3)], 1: [("", 1), ("I", 2), ("II", 3)], 2: [("", 2), ("I", 3)], 3: [("", 3), ("I", 2), ("II", 3)]}


def edits(q, initial, fault):
    yield "D", 4, q
    if fault in (cr.FINE, cr.CUT):
        cut = 3 * (fault == cr.CUT)
        yield "R", 3 + cut, 3 if q == 2 else 2
        after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, initial))
        if after:
            yield "K", cut, after


def cheapest(rows):
    """Table over rows and states; rows are (initial, fault)."""
    best = {0: (0, "")}
    for initial, fault in rows:
        new = {}
        for q, (cost, audit) in best.items():
            for more, p in INSERTS[q]:
                for letter, price, after in edits(p, initial, fault):
                    w = (cost + 3 * len(more) + price, audit + more + letter)
                    new[after] = min(new.get(after, w), w)
        best = new
    ends = [(c + 3 * len(m), a + m) for q, (c, a) in best.items() for m, p in INSERTS[q] if p in (0, 3)]
    return min(ends)


def scripts(rows):
    """Cost and audit of every edit script with few insertions that gives allowed roles."""
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        for letters in itertools.product("DKR", repeat=len(rows)):
            cost, audit, q = 0, "", 0
            for n in range(len(rows) + 1):
                cost, audit = cost + 3 * gaps[n], audit + "I" * gaps[n]
                for _ in range(gaps[n]):
                    q = 3 if q == 2 else 2
                if n == len(rows):
                    break
                found = [(price, after) for letter, price, after in edits(q, *rows[n]) if letter == letters[n]]
                if not found:
                    q = None
                    break
                cost, audit, q = cost + found[0][0], audit + letters[n], found[0][1]
            if q in (0, 3):
                yield cost, audit


def faults(rows):
    """First fault of each (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append(cr.BLANK if not bare else cr.DUPLICATE if (role, text) in seen else cr.FINE if bare[-1] in ".!?" else cr.CUT)
        seen.add((role, text))
    return out


def plain(rows):
    damaged = {}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        damaged.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv, found in damaged.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: cr.HEAD], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        kinds = faults(found)
        turns = {t for t, *_ in found if t is not None}
        cost, audit = cheapest([(r[1][:1], k) for r, k in zip(found, kinds)])
        text, q, left = [], 0, iter(found)
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter != "D":
                role = ("assistant" if q == 2 else "user") if letter != "K" else row[1]
                text.append(f"{role}:{'' if row is None else row[2]}")
                q = {"s": 1, "u": 2, "a": 3}[role[0]]
        roles = [r[1][:1] for r in found]
        out.append(
            (
                conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in (cr.BLANK, cr.DUPLICATE, cr.CUT)),
                sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                hashlib.sha256("\n".join(text).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def digest(spark, rows, **sizes):
    return cr.repaired_digest(cr.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3)), **sizes)


def odd_rows():
    random.seed(3)
    texts = ["Yes.", "no", "", " \t", "Why?\n", "…", "ok!  ", None, "a\nb."]
    roles = ["user", "assistant", "system", None, "", "User", "ask", "\U0001f642"]
    rows = [(random.randrange(150), random.randrange(6), random.choice(roles[:3] * 4 + roles), random.choice(texts), "x") for _ in range(700)]
    rows += [(None, n % 4, "user", f"t{n}.", "x") for n in range(9)] + [(900, None, "assistant", "A.", "x"), (900, 3, "user", "B", "x"), (901, None, "user", "C", None)]
    rows += [(902, n, "system", "S.", "x") for n in range(3)] + [(903, 5, "user", "again.", "x")] * 40 + [(904, 1, "user", "long " * 400_000, "x")]
    return rows + [(1000 + n, 0, "user", "gone.", "x") for n in range(60)] + rows[:30]


def test_repair_is_the_plain_one(spark):
    rows = odd_rows()
    got = result(digest(spark, rows))
    assert got == plain(rows)
    assert any(r[7] == "" for r in got)
    assert result(digest(spark, [])) == []


@pytest.mark.parametrize("fan", [2, 32])
def test_long_conversations_in_fragments(spark, fan):
    """One conversation holds most rows; fragments, partitions and joining rounds change nothing."""
    rows = odd_rows() + [(77_777, n % 450, "user" if n % 3 else "assistant", f"say {n % 211}{'.' if n % 5 else ''}", "x") for n in range(1500)]
    assert result(digest(spark, rows, fragment=7, fan=fan, part_rows=400)) == plain(rows)


def test_fragments_of_any_size_join_to_the_same_weight():
    random.seed(8)
    for n in (0, 1, 5, 40):
        rows = [(random.choice("suax"), random.choice([0, 0, 0, 1, 2, 3]), 1 + (random.random() < 0.1)) for _ in range(n)]
        single = [(i, f if k == 0 or f == cr.BLANK else cr.DUPLICATE) for i, f, times in rows for k in range(times)]
        want = cheapest(single)
        assert min(cr.lightest(0, n, cr.row_steps(rows), goal=True).values()) == want
        for size in (1, 3, 8):
            tables = [cr.all_states(len(part), cr.row_steps(part)) for part in (rows[k : k + size] for k in range(0, n, size))]
            joined = cr.all_states(len(tables), cr.fragment_steps(tables))
            assert min(joined[0, q] for q in (0, 3) if (0, q) in joined) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 3)), max_size=3))
def test_agenda_finds_the_least_of_all_scripts(rows):
    got = min(cr.lightest(0, len(rows), cr.row_steps([(*r, 1) for r in rows]), goal=True).values())
    assert got == min(scripts(rows)) == cheapest(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello.", ""), (1, 1, "user", "Hi.", ""), (1, 2, "user", " ", ""), (2, 4, "user", "Why?", ""), (None, 0, "system", "S.", "")]
    got = sorted(map(tuple, cr.repaired(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(1, 0, "user", ""), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "assistant", ""), (2, 0, "user", "Why?"), (2, 1, "assistant", "")]
