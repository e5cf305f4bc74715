"""Line de-duplication over levelled sorted runs of line hashes.

A run is a table of (line key hash, documents that hold it), bucketed and sorted by the hash. Documents come in
batches. A new batch counts its own line keys, merge-anti-joins those that the runs already know as frequent
(they need no more counting, as one run alone has enough documents), and is added as a run of level 0; a level with
``fanout`` runs is compacted into one run of the next. Compaction and the merge at the end read sorted buckets
side by side. A batch has a bounded number of lines, so its run is as large at any size of the corpus; there are four
at least. At the end all runs are merged once, and the keys that enough documents hold lose their lines everywhere.

Runs are tables of the session's catalog whose files lie below the shared folder; their names are known before
they are written, and all of them go when the work ends or fails, wherever it does. Work on one text grows with its lines, but for a sort of their hashes.

A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Keys are held as 128 bits.

Nulls, empty texts, ties: a null or empty text is one empty line, whose key has no characters and always stays.
Each row counts as a document, equal rows too. A text whose lines all go becomes empty. A row with a null
``doc_id`` is treated like any other. An empty table gives an empty result. Other columns are passed on by
:func:`drop_frequent`, whatever their names (but for names that begin with ``line_runs_``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siglab.llm import storage

DOCUMENTS = 10
#: Batches at least, and lines of a batch at most (16 bytes each, before they are counted).
BATCHES, LINES_A_BATCH = 4, 1 << 31
FANOUT = 2

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def key_hash(key: Column, least: int) -> Column:
    """Two hashes of a key; null for a key of fewer than ``least`` code points, which never counts."""
    return F.when(F.char_length(key) >= least, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key, F.lit(11)).alias("b")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _distinct(hashes: str) -> Column:
    """Each hash of an array once, by sorting: ``array_distinct`` compares structs pair by pair."""
    return _once(F.sort_array(F.filter(hashes, lambda x: x.isNotNull())), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


class Runs:
    """Levels of bucketed, sorted runs (a, b, n), as tables whose files lie below the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"siglab_runs_{uuid.uuid4().hex[:16]}"
        self.made: dict[str, str] = {}

    def _write(self, counts: DataFrame) -> str:
        table = f"{self.name}_{len(self.made)}"
        self.made[table] = storage.new_path(self.spark, table)
        counts.write.format("parquet").option("path", self.made[table]).bucketBy(self.buckets, "a", "b").sortBy("a", "b").saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        storage.delete(self.spark, self.made[table])
        self.made[table] = ""

    def _all(self, tables: list[str]) -> DataFrame:
        out = self.spark.table(tables[0])
        for table in tables[1:]:
            out = out.union(self.spark.table(table))
        return out.groupBy("a", "b").agg(F.sum("n").alias("n"))

    def frequent(self, least: int) -> DataFrame | None:
        tables = [x for level in self.levels for x in level]
        return self._all(tables).filter(F.col("n") >= least).select("a", "b") if tables else None

    def add(self, keys: DataFrame, least: int) -> None:
        """A batch's (a, b), a row for each document and key, joins the runs."""
        counts = keys.groupBy("a", "b").agg(F.count("*").alias("n"))
        known = None
        for table in [x for level in self.levels for x in level]:
            own = self.spark.table(table).filter(F.col("n") >= least).select("a", "b")
            known = own if known is None else known.union(own)
        self._push(self._write(counts if known is None else counts.join(known, ["a", "b"], "left_anti")), 0)

    def _push(self, table: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._all(self.levels[level]))
            full, self.levels[level] = self.levels[level], []
            for old in full:
                self._drop(old)
            self._push(merged, level + 1)

    def close(self) -> None:
        for table in [x for x, path in self.made.items() if path]:
            self._drop(table)
        self.levels = []


def drop_frequent(docs: DataFrame, documents: int = DOCUMENTS, least_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT, lines_a_batch: int = LINES_A_BATCH) -> DataFrame:
    """``docs`` with ``text`` (never null), ``line_runs_n_lines``, ``line_runs_n_dropped``: lines whose key at
    least ``documents`` rows hold are gone."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumn("text", text).withColumn("line_runs_key", F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.octet_length("text").alias("n")))
    lines = F.transform(F.split("text", "\n", -1), lambda x: key_hash(line_key(x), least_chars))
    with storage.Scratch(spark) as scratch:
        keyed = scratch.keep(storage.spread(named.select("line_runs_key", "text")).select("line_runs_key", lines.alias("lines")), "line-keys")
        count = keyed.agg(F.sum(F.size("lines").cast("long"))).first()[0] or 0
        batches = max(batches, -(-count // lines_a_batch))
        batch = F.pmod(F.xxhash64("line_runs_key"), F.lit(batches))
        runs = Runs(spark, fanout)
        try:
            for k in range(batches):
                with storage.shuffles_let_go(spark):
                    runs.add(keyed.filter(batch == k).select(F.explode(_distinct("lines")).alias("x")).select("x.a", "x.b"), documents)
            frequent = scratch.keep(runs.frequent(documents), "frequent-lines")
        finally:
            runs.close()
        each = keyed.select("line_runs_key", F.posexplode("lines").alias("at", "x")).filter("x is not null").select("line_runs_key", "at", "x.a", "x.b")
        gone = storage.materialise(each.join(frequent, ["a", "b"]).groupBy("line_runs_key").agg(F.collect_set("at").alias("line_runs_gone")), "lines-that-go")
    split = F.split("text", "\n", -1)
    kept = F.when(F.col("line_runs_gone").isNull(), F.col("text")).otherwise(_once(split, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "line_runs_gone"), lambda i: F.get(x, i)), "\n")))
    # Which documents lose lines is written first, so its size is known: without the hint a small table would be broadcast, a larger one not.
    both = named.join(gone.withColumnRenamed("line_runs_key", "line_runs_same").hint("merge"), F.col("line_runs_key").eqNullSafe(F.col("line_runs_same")), "left")
    counted = both.withColumn("line_runs_n_lines", F.size(split).cast("long")).withColumn("line_runs_n_dropped", F.coalesce(F.size("line_runs_gone"), F.lit(0)).cast("long")).withColumn("text", kept)
    return counted.select(*(F.col(f"`{c}`") for c in docs.columns), "line_runs_n_lines", "line_runs_n_dropped")
