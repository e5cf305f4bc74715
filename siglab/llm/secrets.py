"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each text is searched for a few kinds of candidates. Every candidate's value is then looked at across the whole
corpus, as a SHA-256 sum: in how many distinct repositories and by how many distinct owners it occurs. A value
that ``owners`` or more owners have is a widely copied example; one that fewer have and that looks random is a
live-looking credential of its owner. Vendor-marked keys are reported as spans of their own only where the
corpus says that they are owner-specific.

Nulls, empty texts, ties: a null text counts as empty; a null owner or repository counts as one value. Rows are
told apart even where they are equal, so repeated rows give repeated results. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab.llm import storage

# The base kinds in the order of their report, with their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the runs of AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ of 16 characters or more
VENDOR = r"(?:ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza|npm_|SG\.)[A-Za-z0-9_.-]{16,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
KINDS = ("assign", "access", "hex", "vendor")
LEAST_ASSIGNED = 12
#: Words that mark a value as a stand-in.
STANDINS = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|0000|1234|test|your"

#: Owners from which a value counts as widely copied.
OWNERS = 3

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(lengths: Column) -> Column:
    """The running sums of an array of numbers, by doubling: each turn adds what stands 1, 2, 4, ... places before, so
    an array of n numbers takes log2(n) turns."""
    turn = lambda acc, step: F.when(F.size(acc) > step, F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - step), F.lit(0)))).otherwise(acc)
    return F.aggregate(F.lit([1 << k for k in range(31)]), lengths, turn)


def _spans(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Start, kind, end (code points, end exclusive) and value of each leftmost non-overlapping match."""

    def placed(match: Column) -> Column:
        ends = running(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match)), match, lambda gap, m: F.char_length(gap) + F.char_length(m)))
        value = lambda m: F.regexp_extract(m, pattern, group) if group else m
        span = lambda m, end: F.struct((end - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value(m).alias("value"))
        return F.when(F.size(match) == 0, F.array().cast(_SPAN)).otherwise(F.zip_with(match, ends, span))

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start, then kind."""
    assigned = F.filter(_spans(text, 0, ASSIGN, 2), lambda x: F.char_length(x["value"]) >= LEAST_ASSIGNED)
    return F.sort_array(F.concat(assigned, _spans(text, 1, ACCESS), _spans(text, 2, HEX), _spans(text, 3, VENDOR)))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def live_looking(value: Column) -> Column:
    """Whether a value could be a random key: digits and letters, six different characters, no stand-in words."""
    various = F.size(F.array_distinct(F.split(value, ""))) >= 6
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & various & ~value.rlike(STANDINS)


def scan(docs: DataFrame, owner: Column, repository: Column, owners: int = OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_owners, live_spans of every row."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(owner.cast("string"), F.lit("~")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("~")).alias("repository")
    )
    hashed = F.transform(F.col("c"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("sum"), live_looking(x["value"]).alias("random")))
    found = storage.materialise(named.select("doc_id", "owner", "repository", candidates(F.col("text")).alias("c")).select("doc_id", "owner", "repository", hashed.alias("spans")).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = found.select("row", "owner", "repository", F.explode("spans").alias("x")).select("row", "owner", "repository", "x", F.col("x.sum").alias("sum"))
    held = each.select("sum", "owner", "repository").distinct().groupBy("sum").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("owner", "repository").alias("repositories"))
    held = storage.materialise(held, "ownership")
    judged = each.join(held, "sum").select("row", "x", "owners", "repositories", (F.col("x.random") & (F.col("owners") < owners)).alias("live"))
    by_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("live"), F.struct(F.col("x.start").alias("start"), F.col("x.kind").alias("kind"), F.col("x.end").alias("end"))))).alias("live"),
        F.count_if(F.col("owners") >= owners).alias("n_copied"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
    )
    base = F.filter("spans", lambda x: x["kind"] < 3)
    plain = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    live = F.coalesce(F.col("live"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    many = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.join(by_row, "row", "left").select(
        "doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat(plain, F.filter(live, lambda x: x["kind"] == 3)))).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("most_owners", F.lit(0)).alias("most_owners"), F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"), _listed(live).alias("live_spans"),
    )
