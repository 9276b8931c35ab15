"""Packing token sequences by vector bin packing with a dot-product heuristic.

Each task packs the documents it reads, group by group, so nothing is shuffled and a group's size is bounded. What
full sequences leave of a document is an item with three sizes: tokens, segments (1) and loss-bearing tokens. The
open sequence takes the item that fits and has the largest dot product of its sizes with what is free; when none
fits, an item is cut to fill it. The last tokens of a task go to sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from threading import Timer

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches between blanks whose ids a worker remembers, in each of two generations.
REMEMBERED = 340_000
#: Different words in lower case, without marks, whose ids it remembers: some 200 bytes each.
WORDS = 690_000
#: Items that are packed together.
GROUP = 1024


class WordIds:
    """Ids of whole texts by a tokenizer that lowers case, drops blanks and never joins letters with other marks.

    The ids of each stretch between blanks are remembered. Of new ones, letters with ASCII marks after them are taken
    apart, and all new letter words are encoded in one go: each ends where an id has the end of a word. Other stretches
    are encoded one by one.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, share: float = 1.0) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # lower case and normal form are seen to before
        self.letters.normalizer = None
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.letters.get_vocab(), json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known, self.older, self.words, self.marks = {}, {}, {}, {"": b""}
        self.most_known, self.most_words = int(REMEMBERED * share), int(WORDS * share)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, stretches: list[str]) -> None:
        bare_words, plain, new, words = [], [], {}, self.words
        for w in stretches:
            if w.isascii() and w.isalpha():
                bare_words.append(w)
                continue
            bare = w.rstrip(self.MARKS)
            low = bare.lower()
            if low.isalpha() and (bare.isascii() or (len(low) == len(bare) and "\u03a3" not in bare and unicodedata.is_normalized("NFC", bare) and unicodedata.is_normalized("NFC", low))):
                plain.append((w, low, w[len(bare) :]))
                if low not in words:
                    new[low] = None
            else:
                self.known[w] = self._encode(w)
        lows = [w.lower() for w in bare_words]
        new.update(dict.fromkeys(set(lows).difference(words)))
        if new:
            ids = np.array(self.letters.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            raw = ids.tobytes()
            words.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))
        marks, known = self.marks, self.known
        known.update(zip(bare_words, map(words.__getitem__, lows), strict=True))
        for w, low, rest in plain:
            if rest not in marks:
                marks[rest] = self._encode(rest)
            known[w] = words[low] + marks[rest]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers.

        Arrow splits texts and tells different stretches apart, of which alone Python looks up the ids; NumPy lays them out.
        """
        split = pc.split_pattern(pa.array([t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        stretches = coded.dictionary.to_pylist()
        if len(self.known) > self.most_known:
            self.known, self.older = {}, self.known
        if len(self.words) > self.most_words:
            self.words.clear()
        if len(self.marks) > self.most_words:
            self.marks = {"": b""}
        known, older = self.known, self.older
        new = []
        for w in stretches:
            if w not in known:
                if (ids := older.get(w)) is not None:
                    known[w] = ids
                else:
                    new.append(w)
        for at in range(0, len(new), 8192):
            self._learn(new[at : at + 8192])
        ids = list(map(known.__getitem__, stretches))
        sizes, at = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, coded.indices.to_numpy()
        own = sizes[at]
        ends = np.cumsum(own)
        place = np.arange(own.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - own), own)
        raw = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
        bounds = (4 * np.append(0, ends)[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@cache
def word_ids(path: str, share: float = 1.0) -> WordIds:
    """One for each worker, which keeps what it has learnt from task to task."""
    return WordIds(path, share)


class Idle:
    """Lets a worker that has had no task for some seconds forget what it has learnt; a task that runs keeps its own."""

    SECONDS = 3.0
    timer: Timer | None = None

    @classmethod
    def ends(cls) -> None:
        if cls.timer:
            cls.timer.cancel()

    @classmethod
    def begins(cls) -> None:
        cls.ends()
        cls.timer = Timer(cls.SECONDS, word_ids.cache_clear)
        cls.timer.daemon = True
        cls.timer.start()


def encoded(of: WordIds, texts: Iterable[str]) -> Iterator[bytes]:
    """The ids of each text, made for some megabytes of text at a time."""
    waiting, size = [], 0
    for text in texts:
        waiting.append(text)
        size += len(text)
        if size > 1 << 22:
            yield from of(waiting)
            waiting, size = [], 0
    yield from of(waiting)


class Packer:
    """Places documents; ``add`` and ``flush`` give pieces (key, start, length, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int) -> None:
        # a sequence never has more segments than tokens
        self.cap = np.array([tokens, segments, loss], np.float64)
        self.limit, self.segments, self.loss_limit = tokens, segments, loss
        self.sequence = 0
        self.items: list[list[int]] = []  # key, start, length, loss tokens (the last ones of an item bear loss)
        self._open()

    def _open(self) -> None:
        self.used, self.held, self.lossy, self.bin = 0, 0, 0, []

    def _close(self) -> list[tuple]:
        out = [(*p, self.sequence, o) for *p, o in self.bin]
        self.sequence += bool(out)
        self._open()
        return out

    def _place(self, key: int, start: int, length: int, loss: int) -> None:
        self.bin.append((key, start, length, self.used))
        self.used, self.held, self.lossy = self.used + length, self.held + 1, self.lossy + loss

    def add(self, key: int, length: int, loss: int) -> list[tuple]:
        """A document's whole sequences go out at once; loss tokens are its last ones."""
        out, full = [], min(self.limit, self.loss_limit)
        whole = length // full if loss else length // self.limit
        size = full if loss else self.limit
        for k in range(whole):
            out.append((key, k * size, size, self.sequence, 0))
            self.sequence += 1
        if rest := length - whole * size:
            self.items.append([key, whole * size, rest, min(loss, rest)])
        if len(self.items) >= GROUP:
            out += self.pack(last=False)
        return out

    def pack(self, last: bool) -> list[tuple]:
        out: list[tuple] = []
        items, n = self.items, len(self.items)
        length, loss = np.array([i[2] for i in items], np.int64), np.array([i[3] for i in items], np.int64)
        while n and length.any():
            free, lossfree = self.limit - self.used, self.loss_limit - self.lossy
            fits = (length > 0) & (length <= free) & (loss <= lossfree)
            one = self.segments - self.held == 1
            if one and free and not (length == free).any() and (length > free).any():
                fits[:] = False  # the last segment fills what is free
            if fits.any() and self.held < self.segments:
                score = length * (free / self.cap[0] ** 2) + loss * (lossfree / self.cap[2] ** 2) + (self.segments - self.held) / self.cap[1] ** 2
                i = int(np.where(fits, score, -1.0).argmax())
                self._place(items[i][0], items[i][1], int(length[i]), int(loss[i]))
                length[i] = loss[i] = 0
            elif not free or not lossfree or self.held >= self.segments:
                out += self._close()
            else:
                i = int(length.argmax())
                quiet = int(length[i] - loss[i])
                part = min(int(length[i]), free, quiet + lossfree)
                self._place(items[i][0], items[i][1], part, max(0, part - quiet))
                items[i][1] += part
                length[i] -= part
                loss[i] = min(int(loss[i]), int(length[i]))
            if self.used == self.limit:
                out += self._close()
        self.items = []
        if last:
            out += self._tail()
        return out

    def _tail(self) -> list[tuple]:
        """The open sequence's pieces, cut anew into sequences of powers of two."""
        pieces, left = [list(p[:3]) for p in self.bin], self.used
        self._open()
        out = []
        while left:
            size = 1 << (left.bit_length() - 1)
            at = 0
            while at < size:
                key, start, length = pieces[0]
                part = min(length, size - at)
                out.append((key, start, part, self.sequence, at))
                at += part
                pieces[0] = [key, start + part, length - part]
                if part == length:
                    pieces.pop(0)
            self.sequence += 1
            left -= size
        return out


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, prompt_end: str | None = None, end_id: int = 2,
    tokens: int = 4096, segments: int | None = None, loss: int | None = None, with_ids: bool = True, share: float = 1.0,
) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, ids (the piece's, as little-endian 32-bit numbers).

    ``loss_col`` names the number of last tokens of a document that bear loss; where it is not given or null, all do
    after the first ``prompt_end`` (a space, tab or line end) of the text, or all if there is none. No sequence has more than
    ``tokens`` tokens, ``segments`` pieces or ``loss`` loss-bearing tokens (at least 1 each; not given, they are
    ``tokens``, which never closes a sequence early). Other columns aren't read, whatever their names.
    ``share`` is the part of ``REMEMBERED`` and ``WORDS`` that a worker remembers; it changes no result.
    A null text is an empty one, which is ``end_id`` alone. Repeated rows are packed as often as they come. Sequence ids are unique,
    and the same whenever the same partitions are read again. An empty table gives no piece.
    """
    kind = dict(docs.dtypes)[id_col]
    columns = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    columns.append(F.col(loss_col).cast("long").alias("loss") if loss_col else F.lit(None).cast("long").alias("loss"))
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def halves(texts: pa.Array) -> Iterator[str]:
        """Each text's prompt and what follows it; a tokenizer that drops blanks joins nothing across them."""
        for t in texts:
            head, found, rest = t.as_py().partition(prompt_end) if prompt_end else ("", "", t.as_py())
            yield from (head, rest) if found else ("", head or rest)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Idle.ends()
        of, base = word_ids(tokenizer, share), TaskContext.get().partitionId() << 40
        packer, waiting, number = Packer(tokens, segments or tokens, loss or tokens), {}, 0
        end = np.array([end_id], "<u4").tobytes()

        def rows(pieces: list[tuple], done: bool) -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in range(8)]
            for key, start, length, sequence, offset in pieces:
                doc, ids = waiting[key]
                part = ids[4 * start : 4 * (start + length)]
                for c, v in zip(cols, (doc, start, length, zlib.crc32(part), len(ids) // 4, base + sequence, offset, part if with_ids else None), strict=True):
                    c.append(v)
            if cols[0]:
                arrays = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays[: 7 + with_ids], names=names[: 7 + with_ids])
            held = {i[0] for i in packer.items} | {p[0] for p in packer.bin}
            for k in [k for k in waiting if done or k not in held]:
                del waiting[k]

        for batch in batches:
            id_type = batch.schema.field(0).type
            out: list[tuple] = []
            parts = encoded(of, halves(batch.column(1)))
            for doc, prompt, rest, bearing in zip(batch.column(0).to_pylist(), parts, parts, batch.column(2).to_pylist(), strict=True):
                ids = prompt + rest + end
                waiting[number] = (doc, ids)
                n = len(ids) // 4
                if bearing is None:
                    bearing = n - len(prompt) // 4
                out += packer.add(number, n, n if bearing is None else max(0, min(n, bearing)))
                number += 1
                if len(out) >= 2048:
                    yield from rows(out, False)
                    out = []
            yield from rows(out, False)
        if number:
            yield from rows(packer.pack(last=True), True)
        Idle.begins()

    return docs.select(*columns).mapInArrow(run, schema)
