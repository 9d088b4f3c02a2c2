"""Operator 7: secrets, by an incremental ledger of blobs. DataFrame expressions only.

A blob is a text, named by its SHA-256. The ledger is a Parquet table of (blob, rule_version, spans): what was scanned
with which rules, and what was found. A run names the blobs of its rows, drops those that the ledger has for this
version of the rules, scans each of the others once, appends them, and joins the findings back to every row (path)
of the blob. Copies meet in an aggregate with a map-side part, so a text that a third of all rows share costs one row
for each task; the join back carries ids and digests only.

Spans are found with split and regexp_extract_all: the lengths of what lies between and within matches, in code
points, give begin and end.

Defined cases: a null text is the empty blob; repeated rows get the same findings; an empty table gives no rows and
adds nothing to the ledger. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import shared_dir

#: Raise it with any change of RULES: blobs are then scanned anew, and old findings stay beside the new ones.
RULE_VERSION = 1

#: Kind, pattern, its group that is measured, and the least length of that group. Matches that are too short use up
#: their text all the same. The first three are the base kinds, in the order that breaks ties.
RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
BASE_KINDS = 3
#: A quick look for any place where a rule could match; texts without are not split.
HINT = r"(?:[0-9a-f]{16}|[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}|AKIA[A-Z0-9]{14}|gh[pousr]_|eyJ|-----BEGIN )"

SPANS = "array<struct<begin:bigint,rank:int,finish:bigint>>"


def _spans(text: Column, rank: int) -> Column:
    """Spans of one rule, in order: begin, the rule's place in RULES, end."""
    _, pattern, group, least = RULES[rank]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
        steps = F.arrays_zip(found.alias("found"), measured.alias("measured"), gaps.alias("gap"))
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            finish = begin + F.coalesce(F.length(x["found"]).cast("bigint"), F.lit(0).cast("bigint"))
            span = F.struct(begin.alias("begin"), F.lit(rank).alias("rank"), finish.alias("finish"))
            long_enough = F.length(x["measured"]) >= least
            return F.struct(finish.alias("at"), F.when(long_enough, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(steps, zero, step, lambda acc: acc["spans"])

    return F.when(F.size(found) > 0, F.element_at(F.transform(F.array(found), place), 1)).otherwise(F.array().cast(SPANS))


def scan(text: Column) -> Column:
    """All spans of a text by begin, then by rule."""
    return F.when(text.rlike(HINT), F.array_sort(F.concat(*[_spans(text, k) for k in range(len(RULES))]))).otherwise(F.array().cast(SPANS))


def update_ledger(rows: DataFrame, ledger: str, version: int = RULE_VERSION) -> DataFrame:
    """Scans the blobs of rows (blob, text) that the ledger lacks for this version; returns the ledger's rows of it.

    Spark commits the appended files together; a run that fails before leaves the ledger as it was.
    """
    spark = rows.sparkSession
    known = read_ledger(spark, ledger, version)
    unseen = rows.join(known.select("blob"), "blob", "left_anti") if known is not None else rows
    once = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    once.select("blob", scan(F.col("text")).alias("spans"), F.lit(version).alias("rule_version")).write.mode("append").partitionBy("rule_version").parquet(ledger)
    return read_ledger(spark, ledger, version)


def read_ledger(spark: SparkSession, ledger: str, version: int) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"blob binary, spans {SPANS}, rule_version int").parquet(ledger).where(F.col("rule_version") == version).drop("rule_version")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def find_secrets(docs: DataFrame, ledger: str | None = None, version: int = RULE_VERSION) -> DataFrame:
    """doc_id and its spans, for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = docs.select("doc_id", text.alias("text")).select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    found = update_ledger(blobs.select("blob", "text"), ledger or shared_dir(docs.sparkSession), version)
    # Two writers that both saw a blob as unseen have added it twice, with the same spans.
    hits = found.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    return blobs.select("doc_id", "blob").join(hits, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:begin:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["begin"].cast("string"), s["finish"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["rank"] < BASE_KINDS)

    def number(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{RULES[rank][0]}")

    return found.select("doc_id", *[number(k) for k in range(BASE_KINDS)], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
