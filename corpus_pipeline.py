"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
order matters: junk goes before it can take part in counts, repeated passages go before near duplicates are looked
for in what is left, and mixing counts only what remains.

Columns beside text, doc_id, source and n_chars are carried along whatever their names are. Every stage takes an empty table to
an empty one; what it does with nulls, ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import SPACES, materialize
from emberlog.llm.linededup import LINE_CHARS, dedup_lines
from emberlog.llm.mixing import mix
from emberlog.llm.neardup import first_of_group
from emberlog.llm.packing import best_fit
from emberlog.llm.quality import keep_good
from emberlog.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of good quality is at least a half and that pass the base rules.

    Null, empty and blank texts fail. The verdict depends on the text alone, so rows that repeat stay or go together.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines and of repeated single lines; n_chars follows. Documents of which no word is left go.

    The first place by id (nulls first), text hash and line stays. Rows that repeat id and text are one document, so
    all of them stay; rows that repeat an id with other texts are documents of their own. Null texts stay as they are.
    """
    done = dedup_lines(docs, line_chars=LINE_CHARS)
    emptied = F.col(done.columns[-1]).isNotNull() & (F.trim("text", F.lit(SPACES)) == "")
    return done.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, a similarity of 0.8 or more.

    The smallest id of a group stays, null ids last; of rows that repeat it, one. Texts without words all stay.
    """
    return first_of_group(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as its source's target asks for.

    A null source is a source of its own, a row without an id draws by its text, rows that repeat an id draw alike, and a text without words
    has size 0, so that it is taken at its source's rate all the same.
    """
    return mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in packed sequences.

    A null or empty text is the end token alone; rows that repeat are packed once for each of them.
    """
    return best_fit(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express expectation-maximisation or the tokenizer; tests/llm/test_llm_pipeline.py holds the whole chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
