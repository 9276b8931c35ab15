"""Conversation repair against all possible edits, and a plain version of the whole query."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from millrace.llm.conversations import repair, repair_damaged

NAMES = {"u": "user", "a": "assistant"}


def every_edit(roles, must_go, cut_off):
    found = []

    def go(i, final, audit, cost):
        most = 4 if i == len(roles) else 3
        for k in range(most):
            for made in itertools.product("ua", repeat=k):
                f, a, c = final + "".join(made), audit + "I" * k, cost + 2 * k
                if i == len(roles):
                    if re.fullmatch(r"(s?(ua)+)?", f):
                        found.append((c, a, f))
                    continue
                go(i + 1, f, a + "D", c + 3)
                if not must_go[i]:
                    go(i + 1, f + (roles[i] or "?"), a + "K", c + cut_off[i])
                    for r in "ua":
                        go(i + 1, f + r, a + "R", c + 2 + cut_off[i])

    go(0, "", "", 0)
    return min(found)


def test_cheapest_and_least_audit():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(4)
        case = [r.choice(["s", "u", "a", "t", "u", "a", ""]) for _ in range(n)], [r.random() < 0.25 for _ in range(n)], [r.random() < 0.3 for _ in range(n)]
        assert repair(*case) == every_edit(*case), case


def slow(roles, must_go, cut_off):
    """All prefixes' endings by role, audits compared from the end: the same as every_edit, for longer conversations."""
    from functools import lru_cache

    @lru_cache(None)
    def after(i, state):
        best = []
        for made, to in (("", state), ("u", "u"), ("a", "a"), ("ua", "a"), ("au", "u")):
            if made and (state in ("", "s", "a")) != (made[0] == "u"):
                continue
            ends = [(0, "", "")] if i == len(roles) and to in ("", "a") else []
            if i < len(roles):
                cost, audit, final = after(i + 1, to)
                ends.append((3 + cost, "D" + audit, final))
                for role, e, c in [] if must_go[i] else [(roles[i], "K", 0), ("u", "R", 2), ("a", "R", 2)]:
                    if (role == "s" and to == "") or (role == "u" and to != "u") or (role == "a" and to == "u"):
                        cost, audit, final = after(i + 1, role)
                        ends.append((c + cut_off[i] + cost, e + audit, role + final))
            best += [(2 * len(made) + c, "I" * len(made) + a, made + f) for c, a, f in ends]
        return min(best) if best else (10**9, "", "")

    return after(0, "")


def test_longer_conversations():
    r = random.Random(4)
    for _ in range(150):
        n = r.randrange(4, 40)
        case = tuple(r.choice("suatuauaua") for _ in range(n)), tuple(r.random() < 0.2 for _ in range(n)), tuple(r.random() < 0.3 for _ in range(n))
        assert repair(*case) == slow(*case), case


def plain(rows):
    by = {}
    for i, turn, role, text in rows:
        own = by.setdefault(i, [])
        spaced = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{spaced(i)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for i, own in by.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        roles = [r[:1] for _, r, _ in own]
        cost, audit, final = slow(tuple(roles), tuple(f in ("b", "d") and f != "" for f in faults), tuple(f == "t" for f in faults))
        lines, at, k = [], 0, 0
        for e in audit:
            if e == "I":
                lines.append(NAMES[final[k]] + ":")
            elif e != "D":
                lines.append((own[at][1] if e == "K" else NAMES[final[k]]) + ":" + own[at][2])
            k += e != "D"
            at += e != "I"
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        out.append((i, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, id string, key string, kind int, copy int"


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("short", [1 << 20, 300, 0])
def test_against_a_plain_version(spark, short):
    r = random.Random(7)
    texts = [None, "", " \t\n", "Yes.", "No", "Well, é!", "Why? ", "\x1c", "end.\x85", "a\nb.", "日本"]
    rows = []
    for i in range(120):
        turns = [r.choice([None, *range(-2, 12)]) for _ in range(r.randrange(1, 12))] if i % 3 else list(range(r.randrange(1, 12)))
        rows += [(i, t, r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice(texts)) for t in turns]
    rows += [(None, t, "user", "Hello there.") for t in range(5)] + [(500, None, "user", None)] * 3
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t % 50}.") for t in range(300)]  # a hot conversation
    rows += rows[:40]
    df = spark.createDataFrame([(*x, "i", "k", 3, 4) for x in rows], SCHEMA).repartition(5)
    assert told(repair_damaged(df, short=short)) == plain(rows)


def test_dropped_and_empty(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.", "", "", 0, 0)], SCHEMA)
    assert told(repair_damaged(df)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert told(repair_damaged(df.limit(0))) == []


def test_the_query(spark):
    from millrace.llm.queries import op12_conversation_repair

    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(op12_conversation_repair(spark, data)) == plain(rows)


def test_a_long_conversation_takes_little():
    n = 200_000
    cost, audit, final = repair(["u", "a"] * (n // 2), [False] * n, [False] * n)
    assert (cost, audit, final) == (0, "K" * n, "ua" * (n // 2))
