"""Repair of conversation structure: a least-cost choice of kept, reroled, deleted and inserted turns.

Rows of a conversation arrive sorted and are reduced to a code each, so a task holds the texts of short conversations
only; a long one is hashed in a second pass, as its rows stream by. The choice is a dynamic programme over the retained
rows: prefix sums price what is deleted between two of them, running minima for each state hold the best row to
continue with, the pair of roles fixes what is inserted, and the audit decides between equal costs.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, null_safe_key

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Bytes of text up to which a conversation is repaired as it is read.
SHORT = 1 << 20
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
STATES = "sua."
FAULTS = ("blank", "duplicate", "truncated")
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
#: What must be inserted between two retained roles, "" being the beginning and "." the end; pairs that aren't here can't be.
INSERTED = {
    "": {"s": "", "u": "", "a": "u", ".": ""}, "s": {"u": "", "a": "u", ".": "ua"}, "u": {"a": "", "u": "a", ".": "a"}, "a": {"u": "", "a": "u", ".": ""},
}


def repair(roles: Sequence[str], must_go: Sequence[bool], cut_off: Sequence[bool]) -> tuple[int, str, str]:
    """Cost, audit and final role initials of the cheapest edits that give ``(s?(ua)+)?``; of equal costs the ASCII-least audit.

    ``roles`` are initials. Of two continuations of equal cost the one with the later next retained row has the least
    audit (D stands before I, K and R), then the one with more inserts, then the one that keeps. So no audits need
    comparing, and what is remembered is one step for each row and state.
    """
    n = len(roles)
    best: dict[str, tuple[int, int]] = {}  # by the next retained row's role: cost of it and all after it plus the prefix sum of deletions before it, and the row
    rows, then = array("q", bytes(24 * n)), bytearray(3 * n)  # for a row and each state: the next retained row and its role

    def onward(after: int, state: str) -> tuple[int, int, str]:
        """Cost, next retained row and its role when ``state`` was the last role and row ``after`` is the next to decide."""
        gone = DELETE * after
        chosen = (DELETE * n - gone + INSERT * len(INSERTED[state]["."]), -n, 0, 0, ".")
        for role, (cost, row) in best.items():
            if role in INSERTED[state]:
                made = len(INSERTED[state][role])
                chosen = min(chosen, (cost - gone + INSERT * made, -row, -made, int(roles[row] != role), role))
        return chosen[0], -chosen[1], chosen[4]

    for i in range(n - 1, -1, -1):
        if must_go[i]:
            continue
        after = {role: onward(i + 1, role) for role in ("sua" if roles[i] == "s" else "ua")}
        for role, (cost, row, to) in after.items():
            rows[3 * i + STATES.index(role)], then[3 * i + STATES.index(role)] = row, STATES.index(to)
            cost += DELETE * i + (KEEP if roles[i] == role else REROLE) + TRUNCATED * cut_off[i]
            if role not in best or cost < best[role][0]:
                best[role] = cost, i
    cost, row, role = onward(0, "")
    audit, final, at, state = [], [], 0, ""
    while True:
        made = INSERTED[state][role]
        audit.append("D" * (row - at) + "I" * len(made))
        final.append(made)
        if row == n:
            return cost, "".join(audit), "".join(final)
        audit.append("K" if roles[row] == role else "R")
        final.append(role)
        at, state, step = row + 1, role, 3 * row + STATES.index(role)
        row, role = rows[step], STATES[then[step]]


class Told:
    """A conversation's turns, read in order: a code and a digest for each, texts as long as they are short."""

    def __init__(self) -> None:
        self.roles: list[str] = []
        self.names: list[str] = []
        self.texts: list[str] | None = []
        self.size = self.no_turn = self.distinct = 0
        self.low = self.high = self.turn = None
        self.blank, self.cut_off, self.digests = bytearray(), bytearray(), bytearray()

    def add(self, turn: int | None, role: str, text: str, short: int) -> None:
        last = _LAST.search(text)
        self.roles.append(role[:1])
        self.blank.append(last is None)
        self.cut_off.append(last is not None and last[0] not in ".!?")
        self.digests += hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if turn is not None:
            self.low = turn if self.low is None else min(self.low, turn)
            self.high = turn if self.high is None else max(self.high, turn)
            self.distinct += turn != self.turn
            self.turn = turn
        if self.texts is not None:
            self.size += len(text) + len(role)
            self.names.append(role)
            self.texts.append(text)
            if self.size > short:
                self.names, self.texts = [], None

    def row(self, full: object) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, final role initials, and the hash unless the conversation is long."""
        n = len(self.roles)
        _, first = np.unique(np.frombuffer(self.digests, np.dtype("V16")), return_index=True)
        blank = np.frombuffer(self.blank, bool) if n else np.zeros(0, bool)
        again = np.ones(n, bool)
        again[first] = False
        again &= ~blank
        cut_off = (np.frombuffer(self.cut_off, bool) if n else blank) & ~again
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        illegal = sum(a + b not in LEGAL for a, b in pairwise(self.roles))
        cost, audit, final = repair(self.roles, (blank | again).tolist(), cut_off.tolist())
        hashed = Hashed(audit, final)
        for name, text in zip(self.names, self.texts or [], strict=True):
            hashed.add(name, text)
        return full, gaps, int(blank.sum()), int(again.sum()), int(cut_off.sum()), illegal, cost, audit, final, None if self.texts is None else hashed.hex()


class Hashed:
    """Hashes a repaired conversation while its rows stream by."""

    def __init__(self, audit: str, final: str) -> None:
        self.audit, self.final, self.at, self.out = audit, final, 0, 0
        self.sha, self.begun = hashlib.sha256(), False

    def _put(self, name: str, text: str) -> None:
        self.sha.update((("\n" if self.begun else "") + name + ":" + text).encode())
        self.begun = True
        self.out += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(NAMES[self.final[self.out]], "")
            self.at += 1

    def add(self, name: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        if edit != "D":
            self._put(name if edit == "K" else NAMES[self.final[self.out]], text)
        self.at += 1

    def hex(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """The rows (id, turn, role, text) after damage by crc32(``id:turn``) % 20; null roles and texts, and nulls of that key, are one space.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes
    its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(spaced("id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("kind")
    rows = turns.select("id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, final string, repaired_sha256 string"


def _sorted(rows: DataFrame, first: Sequence[Column] = ()) -> DataFrame:
    """Rows of a conversation together and in order: by turn (nulls first), of one turn by role and text."""
    return rows.repartition("key").sortWithinPartitions("key", *first, F.col("turn").asc_nulls_first(), "role", "text")


def repaired(rows: DataFrame, short: int = SHORT) -> DataFrame:
    """Per id of ``rows`` (id, turn, role, text; no null role or text): counts of faults, cost, audit and hash of the cheapest repair.

    A null id is a conversation. Rows of one turn are taken by role and text, so repeated rows are duplicates. Roles
    other than user, assistant and system count by their initial; an empty role has none and is never legal. A
    conversation of any length is read in order by one task, which holds about 60 bytes a row, its audit, and ``short``
    bytes of text at most; a longer one's texts stream by once more. An empty table gives an empty one.
    """
    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.select(null_safe_key(F.col("id")).alias("key"), "id", F.col("turn").cast("long").alias("turn"), "role", "text")

    def batch_of(out: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names = ["id", *[f.split()[0] for f in RESULT.split(", ")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, told, out, held, types = None, None, None, [], 0, None
        for batch in batches:
            types = [batch.schema.field("id").type, *[pa.int64()] * 6, *[pa.string()] * 3]
            columns = [batch.column(c).to_pylist() for c in ("key", "id", "turn", "role", "text")]
            for k, i, turn, role, text in zip(*columns, strict=True):
                if k != key:
                    if told:
                        out.append(told.row(own))
                        held += len(out[-1][7])
                    if len(out) >= 4096 or held > 1 << 22:
                        yield batch_of(out, names, types)
                        out, held = [], 0
                    key, own, told = k, i, Told()
                told.add(turn, role, text, short)
        if told:
            out.append(told.row(own))
            yield batch_of(out, names, types)

    found = cut(_sorted(keyed).mapInArrow(read, f"id {kind}, {RESULT}"))
    long = found.filter(F.col("repaired_sha256").isNull()).select(null_safe_key(F.col("id")).alias("key"), "audit", "final")
    if long.isEmpty():
        return found.drop("final")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed, out = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "role", "text", "audit", "final")]
            for k, role, text, audit, final in zip(*columns, strict=True):
                if audit is not None:
                    if hashed:
                        out.append((key, hashed.hex()))
                    key, hashed = k, Hashed(audit, final)
                else:
                    hashed.add(role, text)
        if hashed:
            out.append((key, hashed.hex()))
        yield batch_of(out, ["key", "hash"], [pa.string()] * 2)

    lines = keyed.join(long.select("key"), "key", "left_semi").select("key", "turn", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("final"))
    heads = long.select("key", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", "final")
    later = _sorted(heads.unionByName(lines), [F.col("audit").isNull()]).mapInArrow(hashes, "key string, hash string")
    return (
        found.withColumn("key", null_safe_key(F.col("id"))).join(later, "key", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", "hash")).drop("key", "hash", "final")
    )


def repair_damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", short: int = SHORT) -> DataFrame:
    """Damages the turns and repairs what is left: one row per original id, as :func:`repaired` gives it.

    An id (null is one) without any row after damage has zeros, an empty audit and the hash of an empty string. Null
    roles and texts are one space. Other columns aren't read, whatever their names. An empty table gives an empty one.
    """
    given = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    found = repaired(damaged(given), short).withColumn("key", null_safe_key(F.col("id"))).drop("id")
    every = given.select("id").distinct().withColumn("key", null_safe_key(F.col("id")))
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(found, "key", "left").select(
        F.col("id").alias(id_col), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
