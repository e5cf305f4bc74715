"""Best-fit packing of token sequences: bounded-space online best fit over a bitset of free space.

A packer holds at most ``open_bins`` bins that still take pieces, as one integer whose bit ``f`` tells that some
open bin has ``f`` places free. A piece goes to the bin with the least sufficient space (the lowest set bit from
its length up); where none has room and every bin is taken, the fullest bin (the lowest set bit of all) closes
first. Each task packs what it reads, so no token crosses the network; only the bins still open at a task's end,
at most ``open_bins`` a task, are then packed into one another, group by group: ``tasks`` tasks are a group, so one
task packs ``open_bins * tasks`` leftover bins at most, whatever the size of the table.

Nulls, empty texts, ties: a null text counts as empty and gives the end token alone. Equal rows are packed one by
one; pieces of rows with equal or null ``doc_id`` stay apart, as each row is cut and placed by itself. Bins with
equal space are used last in, first out. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.llm import shingles, storage

CAPACITY = 4096
END = 1
OPEN_BINS = 256
#: Leftover bins of so many tasks are packed together.
TASKS = 32
#: Runs that a worker's memory of tokenized words may hold before it starts anew, and the longest that it keeps: some
#: hundred bytes a run at most, whatever the texts are made of.
WORDS, LONGEST = 600_000, 48


class Packer:
    """Online best fit with a bounded number of open bins; :meth:`put` gives the bin and the place in it."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit, self.held, self.free, self.made = capacity, open_bins, 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            name = self._take(space)
        else:
            if self.held == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, name = self.capacity, self.made
            self.made += 1
        if space > length:
            self.bins.setdefault(space - length, []).append(name)
            self.free |= 1 << (space - length)
            self.held += 1
        return name, self.capacity - space

    def _take(self, space: int) -> int:
        names = self.bins[space]
        name = names.pop()
        if not names:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.held -= 1
        return name

    def leftover(self) -> dict[int, int]:
        """The bins that would still take pieces, and how much each holds."""
        return {name: self.capacity - space for space, names in self.bins.items() for name in names}


#: Latin letters that neither NFC nor lower-casing turns into several, then signs that the pre-tokenizer keeps as one piece.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*%$&#]*)")


class Words:
    """The token ids of texts, as bytes, by a tokenizer whose pieces never cross a space or a line feed.

    Every run between spaces and line feeds is tokenized once and remembered, but for those of more than ``LONGEST``
    code points, which are forgotten after their texts. A run of plain letters and signs is the ids of its letters,
    then of its signs; any other run goes through the tokenizer as it stands.
    """

    def __init__(self, path: str, limit: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.parts = Tokenizer.from_file(path), limit, {}, {"": b""}
        last = self.tokenizer.get_vocab()
        self.final = np.zeros(max(last.values()) + 1, bool)
        self.final[[i for token, i in last.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        plain, other = {}, []
        for run in new:
            if m := _PLAIN.fullmatch(run):
                plain[run] = (m[1].lower(), m[2])
            else:
                other.append(run)
        self.fresh = fresh = [x for x in {y for pair in plain.values() for y in pair} if x not in self.parts]
        for first in range(0, len(fresh), 4096):  # each such part is one piece, so it ends with the one token that ends a word
            part = fresh[first : first + 4096]
            ids = self._encode([" ".join(part)])[0]
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer splits a run of letters or signs")
            data = ids.tobytes()
            self.parts.update(zip(part, (data[4 * x : 4 * y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist()))))
        for run, (letters, signs) in plain.items():
            self.known[run] = self.parts[letters] + self.parts[signs]
        for run, ids in zip(other, self._encode(other)):
            self.known[run] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [x.replace("\n", " ").split(" ") for x in texts]
        new = set(itertools.chain.from_iterable(split))
        new.difference_update(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            self.parts = {"": b""}
            new = set(itertools.chain.from_iterable(split))
        self._learn(new)
        get = self.known.__getitem__
        out = [b"".join(map(get, x)) for x in split]
        for run in [x for x in new if len(x) > LONGEST]:
            del self.known[run]
        for part in [x for x in self.fresh if len(x) > LONGEST]:
            del self.parts[part]
        return out


_TOKENIZERS: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    return _TOKENIZERS[path]


def _packed(texts: list[str], path: str, capacity: int, end: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Index of the text, number of the piece, its start, its ids."""
    tail = np.uint32(end).astype("<u4").tobytes()
    for i, ids in enumerate(_words(path).encode(texts)):
        ids += tail
        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
            yield i, k, at // 4, ids[at : at + 4 * capacity]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row for each piece, placed in a bin of its task: doc_id, piece, start, length, ids_crc32, task, bin,
    offset, left (whether the bin was still open at the end), and ids (bytes, null unless asked for)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "bin", "offset", "ids", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, packer = TaskContext.get().partitionId(), Packer(capacity, open_bins)

        def rows(columns: list[list], still: list[bool] | None = None) -> pa.RecordBatch:
            n = len(columns[0])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([*(pa.array(x, kind) for x, kind in zip(columns, kinds)), pa.array(still or [None] * n, pa.bool_())], names)

        for whole in batches:
            _, bounds = shingles.utf8(whole.column(1))
            for first, last in shingles.blocks(bounds, 1 << 21):
                batch = whole.slice(first, last - first)
                ids, texts, out = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()], []
                for i, k, start, data in _packed(texts, tokenizer, capacity, end):
                    name, offset = packer.put(len(data) // 4)
                    out.append((ids[i], k, start, len(data) // 4, zlib.crc32(data), task, name, offset, data if with_ids else None))
                yield rows([list(x) for x in zip(*out)])
        if left := packer.leftover():  # rows that tell of open bins: task, bin and, as length, what it holds
            n = len(left)
            yield rows([[None] * n, [None] * n, [None] * n, list(left.values()), [None] * n, [task] * n, list(left), [None] * n, [None] * n], [True] * n)

    return storage.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, bin long, offset long, ids binary, open boolean"
    )


def _merge(left: DataFrame, capacity: int, open_bins: int, tasks: int) -> DataFrame:
    """task, bin, in_bin, shift: where each leftover bin goes; ``in_bin`` is a bin of group ``-1 - group``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = Packer(capacity, max(open_bins, 1 << 14)), None
        for batch in batches:
            group, out = batch.column(0).to_pylist(), []
            for g, size in zip(group, batch.column(3).to_pylist()):
                if g != at:
                    packer, at = Packer(capacity, max(open_bins, 1 << 14)), g
                out.append(packer.put(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["group", "task", "bin", "in_bin", "shift"])

    dealt = left.select(F.floor(F.col("task") / tasks).alias("group"), "task", "bin", F.col("length").alias("used"))
    return dealt.repartition("group").sortWithinPartitions("group", F.desc("used"), "task", "bin").mapInArrow(run, "group long, task long, bin long, in_bin long, shift long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, open_bins: int = OPEN_BINS, tasks: int = TASKS, with_ids: bool = False) -> DataFrame:
    """Every row's tokens, in sequences of at most ``capacity``: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with ``with_ids`` the ids (little-endian, four bytes each)."""
    made = storage.materialise(pieces(docs, tokenizer, capacity, end, open_bins, with_ids), "pieces")
    told = made.filter("open").select("task", "bin", "length")
    moved = storage.materialise(_merge(told, capacity, open_bins, tasks), "leftover")
    name = lambda where, bin_: where * F.lit(1 << 32) + bin_
    placed = made.filter("open is null").join(moved, ["task", "bin"], "left")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce(name(-1 - F.col("group"), F.col("in_bin")), name(F.col("task"), F.col("bin"))).alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")]
    return placed.select(*columns, *(["ids"] if with_ids else []))
