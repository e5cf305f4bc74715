"""Alignment of two tokenizers over the same texts, by byte offsets, with DuckDB inside the tasks.

A text with a space before it is encoded by A (byte-level BPE) and by B (pieces; B puts the space itself). A task
turns its Arrow batches into interval tables, one row a token with its end offset, and lets DuckDB align them: a full
join on the ends finds where tokens of both end (the cuts), an ASOF join gives every other token the next cut as its
group, window sums number the groups and find their token counts, and the groups are put together in the order of
their offsets. Counts of linked id pairs are summed in each task, and those partial sums are merged in Spark. A second
pass, over links only, looks up the merged counts.

Linked tokens end together, so the bytes of one are a suffix of the bytes of the other. A token has as many suffixes as
bytes, so there are at most as many different pairs as all entries of both vocabularies have bytes: a bound that doesn't
depend on the documents. The merged counts (two ids, two numbers a pair) are within it and are broadcast.

Long texts are cut into pieces where one space stands between two other characters, a letter after it. A's rule begins a
token there, and no entry of B has a space after another byte (else texts stay whole), so pieces encode as
the whole does, and both end a token at each cut. The ids of one batch of texts and the intervals of one slice are all
that a task holds.

A's ids come from its JSON file. Texts of Latin script take a shorter way to the same ids, ranks of the same vocabulary,
where these are given; others, and those with very long runs of white space, take the JSON file's own way.

Nulls, empty texts, ties: a null or empty text, and one whose tokens don't spell it out again, has no tokens: its counts
are 0 and ``groups`` is ''. Special tokens' strings are ordinary text. Of pairs of one B id that share the highest
count, all are best. Equal rows count each for itself. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglab.llm import storage

#: Characters of a piece of a long text, and tokens that are aligned by one set of joins.
PIECE = 1 << 20
SLICE = 1 << 21

_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")
_LONG_WAY = re.compile(r"[^\x00-ɏ]|\s{1000}")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: What the ranks' file leaves to its reader: the rule by which byte-level BPE of this kind cuts a text. Fixed value.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_FOUND = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, link_a array<int>, link_b array<int>, link_n array<int>, a int, b int, n long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _unprintable() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others, in
    order, for what follows 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class _A:
    """Byte-level BPE: ids of texts, and the length in bytes of every id."""

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=_RULE, mergeable_ranks=table, special_tokens={})
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = _unprintable()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(byte.get(c, 0) for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        if self.quick is not None and not _LONG_WAY.search(text):
            return self.quick.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class _B:
    """Pieces with a space before the text: ids, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(x)) else x.replace("▁", " ").encode() for x in pieces]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.cuts = not any(re.search(rb"[^ ] ", x) for x in self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def _a(path: str, ranks: str | None) -> _A:
    return _A(path, ranks)


@cache
def _b(path: str) -> _B:
    return _B(path)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at single spaces, which go, into pieces of about ``size`` characters; whole where it has no such place."""
    out, begin = [], 0
    while len(text) - begin > size and (cut := _CUT.search(text, begin + size)):
        out.append(text[begin : cut.start()])
        begin = cut.end()
    return [*out, text[begin:]]


def _encoded(texts: list[str], a: _A, b: _B) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Both tokenizers' ids of the pieces of one text, or None where the ids don't spell it."""
    out = []
    for text, ids in zip(texts, b.encode(texts)):
        spelt, own = f" {text}".encode(), a.encode(f" {text}")
        if b"".join(map(b.bytes.__getitem__, ids)) != spelt or b"".join(map(a.bytes.__getitem__, own)) != spelt:
            return None
        out.append((np.array(own, np.int32), np.array(ids, np.int32)))
    return out


_JOINS = (
    # A row for each place where a token ends; both ids where two end.
    "CREATE OR REPLACE TEMP TABLE ends AS SELECT coalesce(a.doc, b.doc) AS doc, a.id AS a, b.id AS b, coalesce(a.e, b.e) AS e FROM a FULL JOIN b ON a.e = b.e",
    "CREATE OR REPLACE TEMP TABLE cuts AS SELECT doc, a, b, e FROM ends WHERE a IS NOT NULL AND b IS NOT NULL",
    # Tokens that end inside a group, in order, by the cut that closes it.
    """CREATE OR REPLACE TEMP TABLE inside AS SELECT g, string_agg(a::VARCHAR, ',') AS a, string_agg(b::VARCHAR, ',') AS b FROM (
        SELECT x.a, x.b, x.e, cuts.e AS g FROM (SELECT a, b, e FROM ends WHERE a IS NULL OR b IS NULL) x ASOF JOIN (SELECT e FROM cuts) cuts ON x.e <= cuts.e ORDER BY x.e) GROUP BY g""",
    "INSERT INTO partial SELECT a, b, count(*) FROM cuts GROUP BY a, b",
)
_TOLD = "SELECT cuts.doc, coalesce(inside.a || ',', '') || cuts.a || '|' || coalesce(inside.b || ',', '') || cuts.b || ';' AS told FROM cuts LEFT JOIN inside ON cuts.e = inside.g ORDER BY cuts.e"
#: Window sums: how many groups a text has up to its last, read off at each text's end.
_GROUPS = "SELECT doc, max(so_far) - min(so_far) + 1 AS n FROM (SELECT doc, sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS so_far FROM cuts) GROUP BY doc ORDER BY doc"
_LINKS = "SELECT doc, a, b, count(*)::INTEGER AS n FROM cuts GROUP BY doc, a, b ORDER BY doc, a, b"


class _Text:
    """What is known of one text while its pieces are aligned."""

    def __init__(self) -> None:
        self.digest, self.told, self.n_a, self.n_b, self.n_groups, self.links = hashlib.sha256(), [], 0, 0, 0, []

    def add(self, told: memoryview, keep: bool) -> None:
        if self.n_groups:
            self.digest.update(b";")
        self.digest.update(told)
        if keep:
            self.told.append(bytes(told).decode())

    def pairs(self) -> np.ndarray:
        """A row (a, b, n) for each linked pair of ids."""
        if len(self.links) == 1:
            return self.links[0]
        key, at = np.unique(np.concatenate([x[:, :2] for x in self.links]), axis=0, return_inverse=True)
        return np.column_stack([key, np.bincount(at.ravel(), weights=np.concatenate([x[:, 2] for x in self.links])).astype(np.int64)])


class _Aligner:
    """DuckDB over the interval tables of one task, slice by slice."""

    def __init__(self, a: _A, b: _B, keep: bool):
        import duckdb

        self.a, self.b, self.keep = a, b, keep
        self.con = duckdb.connect(config={"threads": 1})
        self.con.execute("CREATE TEMP TABLE partial (a INTEGER, b INTEGER, n BIGINT)")

    def align(self, slice_: list[tuple[int, np.ndarray, np.ndarray]], texts: list[_Text | None]) -> None:
        """Adds what the pieces (text number, A's ids, B's ids) of a slice say to their texts. The pieces of a text come in order."""
        of = np.array([x[0] for x in slice_], np.int32)
        for name, lengths, at in (("a", self.a.lengths, 1), ("b", self.b.lengths, 2)):
            ids, counts = np.concatenate([x[at] for x in slice_]), [len(x[at]) for x in slice_]
            table = pa.table({"doc": np.repeat(of, counts), "id": ids, "e": np.cumsum(lengths[ids])})
            self.con.register(name, table)
        for sql in _JOINS:
            self.con.execute(sql)
        told = self.con.sql(_TOLD).to_arrow_table().combine_chunks()
        docs = told.column("doc").to_numpy()
        strings = told.column("told").chunk(0).cast(pa.large_string())
        offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = memoryview(strings.buffers()[2])
        begin = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        for d, i, j in zip(docs[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(docs)]):
            texts[d].add(data[offsets[i] : offsets[j] - 1], self.keep)  # without the last semicolon
        for d, n in self.con.sql(_GROUPS).fetchall():
            texts[d].n_groups += int(n)
        links = self.con.sql(_LINKS).to_arrow_table()
        docs, rows = links.column("doc").to_numpy(), np.column_stack([links.column(c).to_numpy() for c in ("a", "b", "n")]).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        for d, i, j in zip(docs[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(docs)]):
            texts[d].links.append(rows[i:j])
        for d, own, other in slice_:
            texts[d].n_a += len(own)
            texts[d].n_b += len(other)

    def partial(self) -> pa.Table:
        return self.con.sql("SELECT a, b, sum(n)::BIGINT AS n FROM partial GROUP BY a, b ORDER BY a, b").to_arrow_table()


def _rows(ids: pa.Array, texts: list[_Text | None], keep: bool) -> pa.RecordBatch:
    """A record for each text."""
    whole = [x if x is not None else _Text() for x in texts]
    pairs = [x.pairs() if x.links else np.empty((0, 3), np.int64) for x in whole]
    offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    flat = np.concatenate(pairs) if pairs else np.empty((0, 3), np.int64)
    n = len(whole)
    columns = {
        "doc_id": ids, "n_a": [x.n_a for x in whole], "n_b": [x.n_b for x in whole], "n_groups": [x.n_groups for x in whole],
        "groups_sha256": [x.digest.hexdigest() if x.n_groups else "" for x in whole], "groups": [";".join(x.told) for x in whole] if keep else pa.nulls(n, pa.string()),
        **{f"link_{c}": pa.ListArray.from_arrays(offsets, pa.array(flat[:, k], pa.int32())) for k, c in enumerate("abn")}, "a": pa.nulls(n, pa.int32()), "b": pa.nulls(n, pa.int32()), "n": pa.nulls(n, pa.int64()),
    }
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c]) for c in _NAMES], _NAMES)


def _pairs(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    """Records of a task's partial counts, in the form of :func:`_rows`."""
    for x in counts.to_batches():
        empty = {c: pa.nulls(len(x), pa.list_(pa.int32()) if c.startswith("link") else pa.string() if c.startswith("groups") else pa.int64()) for c in _NAMES[:9]}
        yield pa.RecordBatch.from_arrays([*empty.values(), x.column("a").cast(pa.int32()), x.column("b").cast(pa.int32()), x.column("n")], _NAMES)


def aligned(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None = None, with_groups: bool = False, piece: int = PIECE, slice_: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and ``groups``, if asked for) of every row."""
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _a(a_path, ranks_path), _b(b_path)
        work = _Aligner(a, b, with_groups)
        for batch in batches:
            texts: list[_Text | None] = [None] * len(batch)
            held, size = [], 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                ids = _encoded(pieces(text, piece) if b.cuts else [text], a, b) if text else None
                if ids is None:
                    continue
                texts[i] = _Text()
                for own, other in ids:
                    held.append((i, own, other))
                    size += len(own) + len(other)
                    if size >= slice_:
                        work.align(held, texts)
                        held, size = [], 0
            if held:
                work.align(held, texts)
            if len(batch):
                yield _rows(batch.column(0), texts, with_groups)
        yield from _pairs(work.partial())

    slim = storage.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    with storage.Scratch(spark) as scratch:
        found = scratch.keep(slim.mapInArrow(first, _FOUND), "aligned")
        counts = found.filter("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))
        best = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))).toArrow()
        code = (best.column("a").to_numpy().astype(np.int64) << 32) | best.column("b").to_numpy()
        order = np.argsort(code)
        known = spark.sparkContext.broadcast((code[order], best.column("n").to_numpy()[order], best.column("best").to_numpy()[order].astype(np.int64)))

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, n, top = known.value
            for batch in batches:
                lists = [batch.column(5 + k) for k in range(3)]
                begin = lists[0].offsets.to_numpy().astype(np.int64)
                a, b, links = (np.asarray(x.flatten().to_numpy(), np.int64) for x in lists)
                at = np.searchsorted(code, (a << 32) | b)
                sums = [np.r_[0, np.cumsum(x)] for x in (links, links * top[at] if len(at) else links, links * n[at] if len(at) else links)]
                begin -= begin[0] if len(begin) else 0
                told = [pa.array(s[begin[1:]] - s[begin[:-1]]) for s in sums]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(8), *told], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "n_links", "n_best", "count_sum"])

        rows = found.filter("a is null").select(*_NAMES[:5], "link_a", "link_b", "link_n", "groups")
        told = rows.mapInArrow(second, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, n_links long, n_best long, count_sum long")
        wanted = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
        out = storage.materialise(told.select(*wanted), "alignment")
        known.unpersist()
        return out
