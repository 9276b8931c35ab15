"""Windows of n tokens that also start in a document with a smaller id: the ground of both passage dedups.

Tokens are bytes or words. Of each window the m tokens with the least hash are its anchor; equal windows have equal
anchors. First, 32 bits of every anchor's hash and its place go to a bucket, which names the documents whose anchors
another document may have too; no window of the others can repeat. Then consecutive windows with one such anchor
travel together, as one packed string, to the bucket that the anchor names: by its hash for words, by the range of its
leading bytes at sampled splitters for bytes. Equal strings of one batch are settled where they are read, and only the
one of the smallest id travels. The bucket leaves out anchors of a single document, sorts windows by multikey quicksort
(all suffixes of its strings for bytes, those whose hashes agree for words), compares neighbours and gives back the
token ranges that go.

Windows of a frequent anchor go one by one, by the range of their own leading bytes (by their own hash for words). A
range ends between two leading values, so equal windows have a boundary between them only where a window is itself
frequent: it is dealt in parts by document. Each part hands on the windows that hold a least id of its own, and those
are compared across all parts of the range. What a task holds of a bucket is settled whenever it has grown large, which
leaves the least ids alone, so copies never add up.

All rows that move are compressed blobs: one for each batch and bucket on the way out, one for each bucket and group of
documents on the way back. A group has about a batch of text, and both times its documents come by the same exchange.
Splitters, frequent anchors and frequent windows are found in a bounded sample; they only deal out work and never change
results.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a worker cuts up at once, and that a bucket stands for; twice that in large inputs, where a blob for each batch
#: and bucket would be a quarter of the size and four times as many.
BATCH, BUCKET = 2 << 20, 1 << 20
#: Tokens whose anchors are found at once.
STRETCH = 1 << 15
#: Bytes of text that a bucket of anchors alone stands for.
ANCHORS = 16 << 20
#: Ranges at most; with more buckets than that, each range has some, by the anchor's hash. Parts of a range's frequent windows.
RANGES, PARTS = 4096, 64
#: Bytes of strings, and places, that a bucket holds before they are settled.
HELD, PLACES = 4 << 20, 4 << 20
#: Rows of the sample, and bytes of its longest text.
SAMPLE, SAMPLE_TEXT = 2000, 1 << 16
#: An anchor or window is frequent if the sample has it more often than this; so many windows are held to be frequent at most.
OFTEN, HOT = 16, 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
LOW = 24


@dataclass(frozen=True)
class Plan:
    """How texts are cut: n tokens a window, m an anchor; and where anchors go."""

    words: bool
    n: int
    m: int
    buckets: int = 1
    wide: int = 1
    groups: int = 1
    splitters: tuple[int, ...] | None = None
    frequent: tuple[int, ...] = ()
    hot: tuple[int, ...] = ()
    batch: int = field(default_factory=lambda: BATCH)
    held: int = HELD
    places: int = PLACES


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were ever asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            step = np.full(n, BASE, np.uint64)
            step[0] = 1
            cls.up = np.multiply.accumulate(step)
            step[1:] = pow(int(BASE), -1, 1 << 64)
            cls.down = np.multiply.accumulate(step)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    Powers.to(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * Powers.up[: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A polynomial hash of each buf[s:e], wherever it lies."""
    return (pre[e] - pre[s]) * Powers.down[s]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[: len(v) - step], v[step:])
        have += step
    return v


class Tokens:
    """Token bounds of a buffer; bytes need no arrays."""

    def __init__(self, buf: np.ndarray, words: bool) -> None:
        if words:
            gaps = np.flatnonzero((buf == 32) | (buf == 10))
            self.starts, self.ends = np.append(0, gaps + 1), np.append(gaps, len(buf))
            self.count = len(self.starts)
        else:
            self.starts = self.ends = None
            self.count = len(buf)

    def spans(self, first: np.ndarray, many) -> tuple[np.ndarray, np.ndarray]:
        return (first, first + many) if self.starts is None else (self.starts[first], self.ends[first + many - 1])


def packed_words(text: bytes) -> bytes:
    return b" ".join(text.split())


def gathered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the lengths given: each place's run, and its place in that run."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def equal_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether buf[a:a + length] and buf[b:b + length] are the same, for each; in pieces of bounded size."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(length)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        run, place = gathered(length[at:to])
        same = buf[a[at:to][run] + place] == buf[b[at:to][run] + place]
        out[at:to][run[~same]] = False
        at = to
    return out


def characters(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next seven bytes of strings that have ``left`` more bytes, and how many of those seven there are, as numbers that sort like them."""
    masks = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(8)], np.uint64)
    have = np.clip(left, 0, 7)
    return (words[np.minimum(at, len(words) - 1)].astype(np.uint64) & masks[have]) | have.astype(np.uint64)


def multikey_groups(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for each buf[s:e], in sorted order, equal for equal strings: multikey quicksort, all its segments a step at a time.

    Characters are seven bytes. The first ones are sorted at once; then each segment of ties is split at a pivot's
    character into less, equal and more, and equal ones go on to the next character.
    """
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), ">u8", padded, strides=(1,))
    length = e - s
    key = characters(words, s, length)
    order = np.argsort(key)
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])[: len(s)]
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(s)))
    depth = np.full(len(start), 7)
    tied = (size > 1) & ((key[start] & np.uint64(7)) == 7)
    start, size, depth = start[tied], size[tied], depth[tied]
    while len(start):
        run, place = gathered(size)
        base = np.cumsum(size) - size
        rows = order[start[run] + place]
        key = characters(words, s[rows] + depth[run], length[rows] - depth[run])
        pivot = key[base + size // 2]
        less, same = key < pivot[run], key == pivot[run]
        n_less, n_same = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(same, base, dtype=np.int64)
        less_before, same_before = np.cumsum(less) - less, np.cumsum(same) - same
        less_before, same_before = less_before - less_before[base][run], same_before - same_before[base][run]
        to = np.where(less, less_before, np.where(same, n_less[run] + same_before, (n_less + n_same)[run] + place - less_before - same_before))
        order[start[run] + to] = rows
        middle, end, n_more = start + n_less, start + n_less + n_same, size - n_less - n_same
        head[middle[n_less > 0]] = True
        head[end[n_more > 0]] = True
        on = (n_same > 1) & ((pivot & np.uint64(7)) == 7)
        left, right = n_less > 1, n_more > 1
        start, size, depth = (
            np.concatenate([start[left], middle[on], end[right]]),
            np.concatenate([n_less[left], n_same[on], n_more[right]]),
            np.concatenate([depth[left], depth[on] + 7, depth[right]]),
        )
    group = np.empty(len(s), np.int64)
    group[order] = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
    return group


@dataclass
class Rows:
    """Packed windows: ids, text hashes, first token in the document, windows, anchor's token in the span, and bytes."""

    id: np.ndarray
    text: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    length: np.ndarray
    data: bytes

    def pack(self, settled: np.ndarray) -> bytes:
        """All rows as one compressed string: documents once, then each column by its bytes' places."""
        new = np.ones(len(self.id), bool)
        new[1:] = (self.id[1:] != self.id[:-1]) | (self.text[1:] != self.text[:-1])
        cols = (self.id[new], self.text[new], new, np.diff(self.first, prepend=0), self.windows, self.anchor, self.length, *settled.T)
        head = struct.pack("<QQQ", int(new.sum()), len(self.id), len(settled))
        body = [planes(x.astype("<i8")) for x in cols]
        return zstandard.compress(head + b"".join(body) + self.data, 3)

    @classmethod
    def unpack(cls, blob: bytes) -> tuple[Rows, np.ndarray]:
        raw = zstandard.decompress(blob)
        d, n, k = struct.unpack_from("<QQQ", raw)
        at, parts = 24, []
        for size in (d, d, n, n, n, n, n, k, k, k, k):
            parts.append(unplanes(raw, size, at, "<i8"))
            at += 8 * size
        ids, texts, own, first, *rest = parts
        own = np.cumsum(own) - 1
        return cls(ids[own], texts[own], np.cumsum(first), *rest[:3], raw[at:]), np.column_stack(rest[3:])

    @classmethod
    def joined(cls, parts: list[Rows], glue: bytes) -> Rows:
        cols = (np.concatenate([getattr(p, c) for p in parts]) for c in ("id", "text", "first", "windows", "anchor", "length"))
        return cls(*cols, glue.join([p.data for p in parts if len(p.id)]))

    def some(self, mask: np.ndarray, glue: bytes) -> Rows:
        end = np.cumsum(self.length + len(glue)) - len(glue)
        raw, spans = memoryview(self.data), zip((end - self.length)[mask].tolist(), end[mask].tolist(), strict=True)
        return Rows(*(c[mask] for c in (self.id, self.text, self.first, self.windows, self.anchor, self.length)), glue.join([raw[a:b] for a, b in spans]))

    def size(self) -> int:
        return len(self.data) + 48 * len(self.id)


class Cutter:
    """Cuts batches of documents into packed rows of buckets."""

    def __init__(self, plan: Plan) -> None:
        self.plan = plan
        self.splitters = None if plan.splitters is None else np.array(plan.splitters, np.uint64)
        self.frequent, self.hot = np.array(sorted(plan.frequent), np.uint64), np.array(sorted(plan.hot), np.uint64)

    def segments(self, key: int, text_hash: int, text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
        """(id, text hash, first token, bytes) of a document, in overlapping parts where it is long."""
        n, batch = self.plan.n, self.plan.batch
        if not self.plan.words:
            for at in range(0, max(1, len(text) - n + 1), batch):
                yield key, text_hash, at, text[at : at + batch + n - 1]
            return
        text = packed_words(text)
        if len(text) <= batch:
            yield key, text_hash, 0, text
            return
        parts = text.split(b" ")
        for at in range(0, max(1, len(parts) - n + 1), batch // 16):
            yield key, text_hash, at, b" ".join(parts[at : at + batch // 16 + n - 1])

    def anchors(self, docs: list[tuple[int, int, int, bytes]]):
        """The buffer, its prefix sums, tokens, and of each packed row: document, first token, windows, anchor's token, anchor's hash."""
        plan = self.plan
        buf = np.frombuffer((b"\n" if plan.words else b"").join([d[3] for d in docs]), np.uint8)
        tokens = Tokens(buf, plan.words)
        if plan.words:
            # one token at least for each document, so that numbers of tokens follow from the gaps
            sizes = np.array([d[3].count(b" ") + 1 for d in docs], np.int64)
        else:
            sizes = np.array([len(d[3]) for d in docs], np.int64)
        pre, ends = prefix_sums(buf), np.cumsum(sizes)
        none = np.zeros(0, np.int64)
        if tokens.count < plan.n:
            return buf, pre, tokens, ends - sizes, (none, none, none, none, none.astype(np.uint64))
        low = np.uint64((1 << LOW) - 1)
        at = np.empty(tokens.count - plan.n + 1, np.int32)
        for start in range(0, len(at), STRETCH):  # a stretch's numbers stay in a core's cache
            own = at[start : start + STRETCH]
            index = np.arange(start, start + len(own) + plan.n - plan.m)
            h = mixed(span_hash(pre, *tokens.spans(index, plan.m)))
            own[:] = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), plan.n - plan.m + 1) & low).astype(np.int32) + np.int32(start)
        window = np.arange(len(at), dtype=np.int32)
        valid = window + plan.n <= np.repeat(ends, sizes)[: len(at)]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        # two documents' windows never touch: the windows that cross from one to the other lie between them
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(at)))
        own = valid[heads]
        heads, counts = heads[own], counts[own]
        anchor = at[heads].astype(np.int64)
        return buf, pre, tokens, ends - sizes, (np.searchsorted(ends, heads, "right"), heads, counts, anchor, mixed(span_hash(pre, *tokens.spans(anchor, plan.m))))

    def bucket(self, buf: np.ndarray, tokens: Tokens, anchor: np.ndarray, h: np.ndarray) -> np.ndarray:
        if self.splitters is None:
            return (h % np.uint64(self.plan.buckets)).astype(np.int64)
        lead = leading(buf, tokens.spans(anchor, 1)[0])
        low, high = np.searchsorted(self.splitters, lead, "left"), np.searchsorted(self.splitters, lead, "right")
        range_ = np.where(high > low, low + 1 + (h % np.maximum(high - low, 1).astype(np.uint64)).astype(np.int64), low)
        each = self.plan.buckets // (len(self.splitters) + 1)
        return range_ * each + ((h >> np.uint64(20)) % np.uint64(each)).astype(np.int64)

    def places(self, docs: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, bytes]]:
        """Every anchor's hash and place, for its wide bucket; frequent ones have a twin in any case."""
        _, _, _, base, (doc, head, _, _, h) = self.anchors(docs)
        if not len(head):
            return
        ids, texts, firsts = (np.array([d[k] for d in docs], np.int64) for k in range(3))
        at = head - base[doc] + firsts[doc]
        often = np.isin(h, self.frequent) if len(self.frequent) else np.zeros(len(h), bool)
        bucket = np.where(often, (ids[doc] % self.plan.wide), (h % np.uint64(self.plan.wide)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])), len(order))
        short = (h >> np.uint64(32)).astype(np.uint32)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            r = order[a:b]
            used, own = np.unique(doc[r], return_inverse=True)
            yield int(bucket[r[0]]), pack_places(ids[used], texts[used], own, at[r], short[r], often[r])

    def cut(self, docs: list[tuple[int, int, int, bytes]], known: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """Packed rows of the windows whose first tokens are known to have an anchor that another document may have."""
        plan = self.plan
        buf, pre, tokens, base, (doc, head, count, anchor, h) = self.anchors(docs)
        if not len(head):
            return
        ids, texts, firsts = (np.array([d[k] for d in docs], np.int64) for k in range(3))
        at = head - base[doc] + firsts[doc]
        cuts, keep = np.searchsorted(doc, np.arange(len(docs) + 1)), np.zeros(len(head), bool)
        for k, some in enumerate(known):
            a, b = int(cuts[k]), int(cuts[k + 1])
            keep[a:b] = np.isin(at[a:b], some, assume_unique=True)
        doc, head, count, anchor, h = (x[keep] for x in (doc, head, count, anchor, h))
        if not len(head):
            return
        bucket = self.bucket(buf, tokens, anchor, h)
        if len(self.frequent) and (often := np.isin(h, self.frequent)).any():
            run, place = gathered(np.where(often, count, 1))
            head = head[run] + place
            doc, often = doc[run], often[run]
            count, anchor = np.where(often, 1, count[run]), anchor[run]
            own = mixed(span_hash(pre, *tokens.spans(head, plan.n)))
            bucket = np.where(often, self.bucket(buf, tokens, head, own), bucket[run])
            part = (mixed(ids[doc].view(np.uint64)) % np.uint64(PARTS)).astype(np.int64)
            bucket = np.where(often & np.isin(own, self.hot), plan.buckets + bucket * PARTS + part, bucket)
        s, e = tokens.spans(head, count + plan.n - 1)
        content = span_hash(pre, s, e)
        order = np.lexsort((ids[doc], content))
        new = np.ones(len(order), bool)
        new[1:] = (content[order][1:] != content[order][:-1]) | ((e - s)[order][1:] != (e - s)[order][:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.flatnonzero(ids[doc[order]] > ids[doc[first]])
        mine, least = order[later], first[later]
        same = equal_spans(buf, s[mine], s[least], (e - s)[mine])
        gone = np.zeros(len(head), bool)
        gone[mine[same]] = True
        at = head - base[doc] + firsts[doc]
        settled = np.column_stack([ids[doc], texts[doc], at, at + count + plan.n - 1])[gone]
        rest = np.flatnonzero(~gone)
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        raw = memoryview(buf)
        data = [raw[a:b] for a, b in zip(s[rest].tolist(), e[rest].tolist(), strict=True)]
        edges = np.append(np.flatnonzero(np.append(True, bucket[rest][1:] != bucket[rest][:-1])), len(rest)) if len(rest) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            r = rest[a:b]
            glue = b"\n" if plan.words else b""
            yield int(bucket[r[0]]), Rows(ids[doc[r]], texts[doc[r]], at[r], count[r], anchor[r] - head[r], (e - s)[r], glue.join(data[a:b])).pack(settled[:0])
        if len(settled):
            empty = np.zeros(0, np.int64)
            yield int(bucket[0]), Rows(empty, empty, empty, empty, empty, empty, b"").pack(settled)


def planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second bytes, and so on: zeros then cost nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, n: int, at: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def pack_places(ids: np.ndarray, texts: np.ndarray, own: np.ndarray, at: np.ndarray, short: np.ndarray, sure: np.ndarray) -> bytes:
    n = len(own)
    step = np.diff(at, prepend=0)
    raw = struct.pack("<QQ", len(ids), n) + ids.astype("<i8").tobytes() + texts.astype("<i8").tobytes() + planes(np.diff(own.astype("<i4"), prepend=0).astype("<i4")) + planes(step.astype("<i8")) + sure.astype(np.uint8).tobytes() + planes(short.astype("<u4"))
    return zstandard.compress(raw, 1)


def unpack_places(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(blob)
    d, n = struct.unpack_from("<QQ", raw)
    at = 16 + 16 * d
    ids, texts = np.frombuffer(raw, "<i8", d, 16), np.frombuffer(raw, "<i8", d, 16 + 8 * d)
    own, place = np.cumsum(unplanes(raw, n, at, "<i4")), np.cumsum(unplanes(raw, n, at + 4 * n, "<i8"))
    sure, short = np.frombuffer(raw, np.uint8, n, at + 12 * n), unplanes(raw, n, at + 13 * n, "<u4")
    return ids[own], texts[own], place, short, sure.astype(bool)


def by_group(groups: int, ids: np.ndarray, texts: np.ndarray, first: np.ndarray, *more: np.ndarray) -> pa.RecordBatch | None:
    """One row for each group of documents, with what is told of them as one compressed string."""
    if not len(ids):
        return None
    group = (ids ^ texts) % groups
    order = np.lexsort((first, texts, ids, group))
    group, ids, texts, first = group[order], ids[order], texts[order], first[order]
    more = tuple(m[order] for m in more)
    new = np.append(True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]))
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
    blobs = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        heads = np.flatnonzero(new[a:b]) + a
        cols = (ids[heads], texts[heads], new[a:b], np.diff(first[a:b], prepend=0), *(m[a:b] for m in more))
        blobs.append(zstandard.compress(struct.pack("<QQ", len(heads), b - a) + b"".join(planes(c.astype("<i8")) for c in cols), 1))
    return pa.RecordBatch.from_arrays([pa.array(group[edges[:-1]], pa.int64()), pa.array(blobs, pa.binary())], names=["_b", "told"])


def told(blobs: list[bytes], values: int) -> dict[tuple[int, int], list[np.ndarray]]:
    """What by_group() packed, for each (id, text hash)."""
    parts: dict[tuple[int, int], list[tuple]] = {}
    for blob in blobs:
        raw = zstandard.decompress(blob)
        d, n = struct.unpack_from("<QQ", raw)
        at, cols = 16, []
        for size in (d, d, *[n] * (2 + values)):
            cols.append(unplanes(raw, size, at, "<i8"))
            at += 8 * size
        ids, texts, new, first, *more = cols
        first, edges = np.cumsum(first), np.append(np.flatnonzero(new), n).tolist()
        for i, t, a, b in zip(ids.tolist(), texts.tolist(), edges[:-1], edges[1:], strict=True):
            parts.setdefault((i, t), []).append((first[a:b], *(m[a:b] for m in more)))
    return {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in parts.items()}


def shared_places(held: list[tuple[np.ndarray, ...]], known: np.ndarray, groups: int) -> tuple[pa.RecordBatch | None, tuple[np.ndarray, ...], np.ndarray]:
    """Of a wide bucket's places: told are those whose anchors two ids have, or that are known or sure; the others; and the anchors now known."""
    ids, texts, at, short, sure = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(short, kind="stable")
    heads = np.flatnonzero(np.append(True, short[order][1:] != short[order][:-1])[: len(short)])
    low, high = (f.reduceat(ids[order], heads) if len(heads) else ids for f in (np.minimum, np.maximum))
    known = np.union1d(known, short[order][heads][low != high])
    keep = sure | np.isin(short, known)
    return by_group(groups, ids[keep], texts[keep], at[keep]), tuple(c[~keep] for c in (ids, texts, at, short, sure)), known


def leading(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number that sorts like them."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), ">u8", padded, strides=(1,))[at].astype(np.uint64)


def later_windows(rows: Rows, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(id, text hash, first token, end) of the token ranges of windows whose strings a smaller id of these rows has too; and which rows have others."""
    gap = int(plan.words)
    none, stays = np.zeros((0, 4), np.int64), np.ones(len(rows.id), bool)
    if not len(rows.id):
        return none, stays
    buf = np.frombuffer(rows.data, np.uint8)
    pre, tokens = prefix_sums(buf), Tokens(buf, plan.words)
    start = np.cumsum(rows.length + gap) - rows.length - gap
    size = rows.windows + plan.n - 1
    token = np.cumsum(size) - size
    kh = span_hash(pre, *tokens.spans(token + rows.anchor, plan.m))
    # anchors of a single id have no twin
    order = np.argsort(kh, kind="stable")
    heads = np.flatnonzero(np.append(True, kh[order][1:] != kh[order][:-1]))
    low, high = np.minimum.reduceat(rows.id[order], heads), np.maximum.reduceat(rows.id[order], heads)
    own = np.sort(order[np.repeat(low != high, np.diff(np.append(heads, len(order))))])
    if not len(own):
        return none, stays
    # each different string once, with the smallest id that has it
    content = span_hash(pre, start[own], start[own] + rows.length[own])
    order = np.lexsort((rows.id[own], rows.length[own], content))
    new = np.append(True, (content[order][1:] != content[order][:-1]) | (rows.length[own][order][1:] != rows.length[own][order][:-1]))
    of = np.cumsum(new) - 1
    first = order[new][of]
    odd = ~equal_spans(buf, start[own[order]], start[own[first]], rows.length[own[order]])
    if odd.any():  # a hash in common only: a string of its own
        of = np.cumsum(new | odd | np.append(False, odd[:-1])) - 1
        first = order[np.append(True, of[1:] != of[:-1])][of]
    string = np.empty(len(own), np.int64)
    string[order] = of
    one = own[order[np.append(True, of[1:] != of[:-1])]]
    run, place = gathered(rows.windows[one])
    s, e = tokens.spans(token[one][run] + place, plan.n)
    first_id = rows.id[one][run]
    if plan.splitters is None:  # hashes tell which windows to sort
        wh = span_hash(pre, s, e)
        order = np.argsort(wh, kind="stable")
        differ = wh[order][1:] != wh[order][:-1]
        tied = order[~(np.append(True, differ) & np.append(differ, True))]
    else:
        tied = np.arange(len(s))
    if len(tied):
        group = multikey_groups(buf, s[tied], e[tied])
        order = np.argsort(group, kind="stable")
        heads = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        least = np.minimum.reduceat(first_id[tied][order], heads)
        first_id[tied[order]] = np.repeat(least, np.diff(np.append(heads, len(order))))
    begin = np.cumsum(rows.windows[one]) - rows.windows[one]
    out = []
    for at in range(0, len(own), 1 << 15):
        r, g = own[at : at + (1 << 15)], string[at : at + (1 << 15)]
        run, place = gathered(rows.windows[r])
        gone = first_id[begin[g][run] + place] < rows.id[r][run]
        opens = gone & np.append(True, ~gone[:-1] | (run[1:] != run[:-1]))
        closes = gone & np.append(~gone[1:] | (run[1:] != run[:-1]), True)
        mine = r[run[opens]]
        stays[r] = ~np.logical_and.reduceat(gone, np.cumsum(rows.windows[r]) - rows.windows[r])
        out.append(np.column_stack([rows.id[mine], rows.text[mine], rows.first[mine] + place[opens], rows.first[mine] + place[closes] + plan.n]))
    return np.concatenate(out), stays


def plan_for(docs: DataFrame, n_rows: int, n_bytes: int, words: bool, n: int, m: int, ranged: bool) -> Plan:
    """Buckets by the bytes of all texts; splitters, frequent anchors and frequent windows by a sample of about SAMPLE rows."""
    batch_bytes = max(BATCH, min(2 * BATCH, n_bytes >> 9))
    buckets = max(1, -(-n_bytes // max(BUCKET, min(2 * BUCKET, n_bytes >> 11))))
    ranges = min(buckets, RANGES)
    buckets = -(-buckets // ranges) * ranges
    every = max(1, n_rows // SAMPLE)
    sample = docs.filter((F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(every)) == 0) & F.col("_bytes").between(n, SAMPLE_TEXT)).select("_id", "_text").limit(SAMPLE)
    cutter, lead, seen, batches, size = Cutter(Plan(words, n, m)), [], [], [[]], 0
    for row in sample.toLocalIterator():
        if size > BATCH:
            batches, size = [*batches, []], 0
        batches[-1] += cutter.segments(row[0], 0, row[1].encode())
        size += len(row[1])
    for batch in filter(None, batches):
        buf, _, tokens, _, (_, _, _, anchor, h) = cutter.anchors(batch)
        seen.append(h)
        lead.append(leading(buf, tokens.spans(anchor, 1)[0]))
    hashes, leads = np.concatenate([*seen, np.zeros(0, np.uint64)]), np.sort(np.concatenate([*lead, np.zeros(0, np.uint64)]))
    values, counts = np.unique(hashes, return_counts=True)
    frequent = values[counts > max(OFTEN, 2 * len(hashes) // buckets)]
    own = []
    for batch in filter(None, batches if len(frequent) else []):
        _, pre, tokens, _, (_, head, count, _, h) = cutter.anchors(batch)
        often = np.isin(h, frequent)
        run, place = gathered(count[often])
        own.append(mixed(span_hash(pre, *tokens.spans(head[often][run] + place, n))))
    windows, counts = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
    hot = windows[counts > OFTEN][np.argsort(-counts[counts > OFTEN], kind="stable")[:HOT]]
    splitters = None
    if ranged:
        splitters = tuple(leads[np.arange(1, ranges) * len(leads) // ranges].tolist()) if len(leads) else ()
    return Plan(words, n, m, int(buckets), max(1, -(-n_bytes // ANCHORS)), prime(max(1, -(-n_bytes // batch_bytes))), splitters, tuple(frequent.tolist()), tuple(hot.tolist()), batch_bytes, HELD, PLACES)


def prime(n: int) -> int:
    """The first prime from n on: ids in steps of any size then fall evenly into so many groups."""
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def with_repeats(docs: DataFrame, id_col: str, text_col: str, words: bool, n: int, m: int, ranged: bool, finish, schema: str) -> DataFrame:
    """Maps (whole text as UTF-8, covered ranges' starts and sizes) of every row by ``finish`` to the columns of ``schema``, after the id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    size = F.octet_length(text).cast("long")
    per_id = docs.groupBy(key.alias("_id")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    most, n_rows, n_bytes = per_id.agg(*[F.coalesce(c, F.lit(0)) for c in (F.max("n"), F.sum("n"), F.sum("bytes"))]).first()
    # texts' hashes tell rows of one id apart; they cost 8 bytes with each place, so they are 0 where every id has one row
    repeated = most > 1
    base = docs.select(key.alias("_id"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("_t"), text.alias("_text"))
    if repeated:  # equal rows go as one
        base = base.groupBy("_id", "_t", "_text").agg(F.count("*").alias("_n"))
    base = base.withColumn("_bytes", F.octet_length("_text").cast("long"))
    plan = plan_for(base, n_rows, n_bytes, words, n, m, ranged)
    glue = b"\n" if words else b""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    blob_kind, told_kind = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())]), "_b long, told binary"
    copies = ("_n long, ", [("_n", pa.int64())]) if repeated else ("", [])
    out_kind = pa.schema([("_id", pa.int64()), *copies[1], *[(x, kinds[k]) for x, k in (f.split() for f in schema.split(", "))]])

    def rows_of(table) -> Iterator[tuple[int, int, bytes]]:
        for k, t, x in zip(table.column("_id").to_pylist(), table.column("_t").to_pylist(), table.column("_text"), strict=True):
            yield k, t, x.as_py().encode()

    def batched(rows, use) -> Iterator[pa.RecordBatch]:
        """Feeds segments of about a batch, with what is known of each, to ``use``, which gives buckets and blobs."""
        cutter, waiting, known, size = Cutter(plan), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if found := list(use(cutter, waiting, known)):
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], schema=blob_kind)

        for k, t, x, some in rows:
            for segment in cutter.segments(k, t, x):
                if len(segment[3]) < n:
                    continue
                waiting.append(segment)
                known.append(some)
                size += len(segment[3])
                if size >= plan.batch:
                    yield from out()
                    waiting, known, size = [], [], 0
        if waiting:
            yield from out()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((*r, None) for b in batches for r in rows_of(b)), lambda cutter, waiting, known: cutter.places(waiting))

    def bucketwise(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
        pairs = ((bucket, blob) for batch in batches for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for bucket, of in groupby(pairs, key=lambda p: p[0]):
            yield bucket, (blob.as_py() for _, blob in of)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in bucketwise(batches):
            held, size, limit, known = [], 0, plan.places, np.zeros(0, np.uint32)
            for blob in blobs:
                held.append(unpack_places(blob))
                size += len(held[-1][0])
                if size > limit:
                    found, rest, known = shared_places(held, known, plan.groups)
                    held, size = [rest], len(rest[0])
                    limit = max(limit, 2 * size)
                    if found is not None:
                        yield found
            if (found := shared_places(held, known, plan.groups)[0]) is not None:
                yield found

    def cut_up(docs: pa.Table, places: pa.Table) -> pa.Table:
        known = told(places.column("told").to_pylist(), 0)
        rows = ((k, t, x, np.sort(known[(k, t)][0])) for k, t, x in rows_of(docs) if (k, t) in known)
        return pa.Table.from_batches(list(batched(rows, lambda cutter, waiting, some: cutter.cut(waiting, some))), blob_kind)

    def settle(bucket: int, blobs: Iterator[bytes]) -> Iterator[tuple[np.ndarray, Rows | None]]:
        """Ranges found in a bucket, bit by bit; with the last ones the rows that hold least ids."""
        parts, size, limit = [], 0, plan.held
        for blob in blobs:
            rows, settled = Rows.unpack(blob)
            yield settled, None
            parts.append(rows)
            size += rows.size()
            if size > limit:
                rows = Rows.joined(parts, glue)
                found, stays = later_windows(rows, plan)
                yield found, None
                parts = [rows.some(stays, glue)]
                size = parts[0].size()
                limit = max(limit, 2 * size)
        rows = Rows.joined(parts, glue)
        found, stays = later_windows(rows, plan)
        yield found, rows.some(stays, glue) if bucket >= plan.buckets else None

    def answers(buckets: Iterator[tuple[int, Iterator[bytes]]]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for bucket, blobs in buckets:
            for ranges, rest in settle(bucket, blobs):
                found.append(ranges)
                size += len(ranges)
                if size > 1 << 18:
                    yield told_of(found)
                    found, size = [], 0
                if rest is not None and len(rest.id):
                    blob = rest.pack(np.zeros((0, 4), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - (bucket - plan.buckets) // PARTS], pa.int64()), pa.array([blob], pa.binary())], names=["_b", "told"])
        if size:
            yield told_of(found)

    def told_of(found: list[np.ndarray]) -> pa.RecordBatch:
        ids, texts, starts, ends = np.concatenate(found).T
        return by_group(plan.groups, ids, texts, starts, ends - starts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answers(bucketwise(batches))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares the parts of frequent windows (with negative numbers, which come first); all else passes."""
        batches, through = iter(batches), []

        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                after = batch.column(0).to_numpy() >= 0
                through.append(batch.filter(pa.array(after)))
                if not after.all():
                    yield batch.filter(pa.array(~after))
                if after.any():
                    return

        yield from answers(bucketwise(parts()))
        yield from through
        yield from batches

    def finished(docs: pa.Table, found: pa.Table) -> pa.Table:
        known = told(found.column("told").to_pylist(), 1)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = docs.column("_n").to_pylist() if repeated else [None] * docs.num_rows
        rows = [(k, *[n] * repeated, *finish(x, *known.get((k, t), none))) for (k, t, x), n in zip(rows_of(docs), counts, strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_kind, strict=True)], schema=out_kind) if rows else out_kind.empty_table()

    def dealt(blobs: DataFrame, use) -> DataFrame:
        return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(use, told_kind)

    # both times that documents meet what is told of them they come by one exchange, which is made once
    grouped = base.select(F.pmod(F.col("_id").bitwiseXOR(F.col("_t")), F.lit(plan.groups)).alias("_b"), *base.drop("_bytes").columns).groupBy("_b")
    shared = dealt(base.filter(F.col("_bytes") >= n).select("_id", "_t", "_text").mapInArrow(place, "bucket long, blob binary"), share)
    found = dealt(grouped.cogroup(shared.groupBy("_b")).applyInArrow(cut_up, "bucket long, blob binary"), judge)
    if plan.hot:
        found = found.repartition("_b").sortWithinPartitions("_b").mapInArrow(across, told_kind)
    out = grouped.cogroup(found.groupBy("_b")).applyInArrow(finished, f"_id long, {copies[0]}{schema}")
    if repeated:
        out = out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return out.select(F.when(F.col("_id") != -(1 << 63), F.col("_id")).cast(docs.schema[id_col].dataType).alias(id_col), *names)


def covered(length: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of so many tokens the ranges cover."""
    if not len(starts):
        return np.zeros(length, bool)
    edge = np.bincount(starts, minlength=length + 1) - np.bincount(starts + sizes, minlength=length + 1)
    return np.cumsum(edge[:length]) > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, anchor: int = 16) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): texts without the bytes that a string of ``length`` bytes covers which also starts in a smaller id.

    Suffixes are range-partitioned in runs, by the leading bytes of their anchor, at sampled splitters, and sorted in
    their buckets. Strings are judged on the input; kept is binary, since cuts may fall within a character. A null text is empty; texts shorter than ``length`` lose nothing.
    A null id is below all others. Rows of one id never remove each other's bytes, and each loses what smaller ids
    have; repeated rows get equal results. An empty table gives an empty table.
    """

    def finish(text: bytes, starts, sizes):
        gone = covered(len(text), starts, sizes)
        n = int(gone.sum())
        if not n:
            return len(text), 0, 0, text
        return len(text), n, int((gone & ~np.append(False, gone[:-1])).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()

    return with_repeats(docs, id_col, text_col, False, length, min(anchor, length), True, finish, "n_bytes long, n_removed long, n_spans long, kept binary")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 13, minimiser: int = 5) -> DataFrame:
    """(id, n_words, n_removed, kept): texts without the words that a window of ``words`` words covers which also starts in a smaller id.

    Super-k-mers (consecutive windows with one minimiser of ``minimiser`` words) go to the minimiser's bucket. Windows are
    judged on the input; kept words are joined by one space. Nulls, short and empty texts, repeated rows and empty
    tables as in suffix_dedup().
    """

    def finish(text: bytes, starts, sizes):
        parts = text.split()
        gone = covered(len(parts), starts, sizes)
        n = int(gone.sum())
        return len(parts), n, b" ".join(parts if not n else [w for w, g in zip(parts, gone.tolist(), strict=True) if not g]).decode()

    return with_repeats(docs, id_col, text_col, True, words, min(minimiser, words), False, finish, "n_words long, n_removed long, kept string")
