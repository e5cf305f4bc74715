"""A corpus pipeline: toxic documents go, frequent lines go, near copies go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``; all but the last return the columns of ``documents``. The result has a row for each piece of a
document with its token ids, so a sequence is rebuilt from its own rows: those of one ``sequence_id``, by ``offset``.

Nulls, empty texts, ties, in every stage: a null or empty text is a document without words. It isn't toxic unless the
labels make most texts so; line removal keeps it, as an empty text; all such documents are one class of near copies,
of which one stays; it is mixed like others, and packed as the end token alone. A null ``doc_id`` or ``source`` is a
value like others. Equal rows are judged alike; near-dedup keeps one of them, and of texts that share an id each
that is no near copy. An empty table gives an empty result. Columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglab.llm import dart_dedup, line_runs, mixing, packing, queries, storage, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go, each by its own text. Only the labels come from ``sf_dir``."""
    scored = toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS)
    return scored.filter("toxic = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; every document stays, with ``n_chars`` of what is left."""
    return line_runs.drop_frequent(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return dart_dedup.deduplicate(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the tempered shares of their sources, in a global random order."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents in sequences, with their ids (four bytes each, little-endian)."""
    return packing.pack(docs, queries.tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages of toxicity, near copies and packing can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``. What is between two stages is written to the shared folder, and
    deleted with the stage's own tables once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with storage.Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            began = storage.mark()
            out = scratch.keep(stage(spark, docs, sf_dir), name)
            storage.release(began)
            scratch.drop(docs)
            docs = out
        return storage.materialise(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
