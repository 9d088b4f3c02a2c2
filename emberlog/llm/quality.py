"""Operator 9: quality rules as weak supervision. DataFrame expressions only.

Each rule looks at a document's counts and votes good, votes bad or abstains. How often a rule is right, apart for
good and for bad documents, is estimated by expectation-maximisation over all documents; the posterior probability
of good quality decides. Votes are first counted by pattern: there are at most 3**rules patterns, so what EM works on
is bounded by the rules, not by the corpus, and its result goes back as one literal map from pattern to probability.

All counts are made inside the row by built-in functions, with no shuffle of words. Sorting hashed 3-word windows
finds those that occur twice in O(n log n), whatever the text's length.

Defined cases: null and blank texts have no words and fail the base rules; repeated rows are judged alike; an empty
table gives no rows; other columns, clashing names included, are ignored by counts() and kept by keep_good().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import SPACES, materialize, word_array

SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_hashes(h: Column) -> Column:
        windows = F.when(F.size(h) >= 3, F.zip_with(F.zip_with(F.slice(h, 1, F.size(h) - 2), F.slice(h, 2, F.size(h) - 2), lambda a, b: F.xxhash64(a, b)), F.slice(h, 3, F.size(h) - 2), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
        return _with(windows, of_windows)

    def of_windows(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(_with(ordered, covered))

    def covered(s: Column) -> Column:
        alike = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(alike, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return _with(hashes, of_hashes)


def _with(value: Column, body) -> Column:
    """body(value), with value computed once: expressions inside lambdas don't share common parts."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _counts(text: Column) -> Column:
    """All counts of a text as one struct, so that a filter on them evaluates each once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")

    def fields(words: Column) -> Column:
        return _with(
            lines,
            lambda lines: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
            ),
        )

    return _with(word_array(text), fields)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules use, over whole texts."""
    return docs.select("doc_id", _counts(F.col("text")).alias("counts")).select("doc_id", "counts.*")


Count = Callable[[str], Column]
#: Name, then when a rule votes bad and when good; it abstains otherwise. Ratios are to words, characters or lines.
RULES: tuple[tuple[str, Callable[[Count], Column], Callable[[Count], Column]], ...] = (
    ("length", lambda c: c("n_words") < 50, lambda c: c("n_words") >= 80),
    ("repeats", lambda c: c("n_repeat_words") > 0.3 * c("n_words"), lambda c: c("n_repeat_words") < 0.1 * c("n_words")),
    ("symbols", lambda c: c("n_symbols") > 0.02 * c("word_chars"), lambda c: c("n_symbols") < 0.005 * c("word_chars")),
    ("marks", lambda c: c("n_symbols") > 0.2 * c("n_words"), lambda c: c("n_symbols") < 0.02 * c("n_words")),
    ("lines", lambda c: (c("n_dup_lines") >= 3) & (c("n_dup_lines") > 0.5 * c("n_lines")), lambda c: c("n_dup_lines") < 0.1 * c("n_lines")),
    ("word length", lambda c: ~c("word_chars").between(3 * c("n_words"), 10 * c("n_words")), lambda c: c("word_chars").between(4 * c("n_words"), 7 * c("n_words"))),
    ("shouting", lambda c: c("n_bangs") > 0.2 * c("n_words"), lambda c: c("n_bangs") < 0.05 * c("n_words")),
)


def base_failed(c: Count) -> Column:
    """What fails whatever the votes are."""
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def vote_pattern(c: Count, rules=RULES) -> Column:
    """The votes as one number in base 3: 0 bad, 1 none, 2 good."""
    votes = [F.when(bad(c), 0).when(good(c), 2).otherwise(1) * 3**k for k, (_, bad, good) in enumerate(rules)]
    return sum(votes[1:], votes[0]).cast("int")


def posteriors(patterns: dict[int, int], n_rules: int, rounds: int = 200) -> tuple[list[float], list[tuple[list[float], list[float]]]]:
    """Probability of good quality by pattern, and how each rule votes on good and on bad documents, by EM.

    Rules vote or abstain independently given the class; a rule's row of three probabilities (bad, none, good) for a
    class holds its accuracy and its coverage. EM starts from "bad where any rule says so". A Dirichlet prior worth a
    thousandth of the documents holds rules to be better than chance, so one that never fires stays defined.
    patterns: how many documents have each.
    """
    votes = {p: [(p // 3**k) % 3 for k in range(n_rules)] for p in range(3**n_rules)}
    total = sum(patterns.values())
    weight = max(1.0, total / 1000)
    prior = ((0.02, 0.18, 0.8), (0.4, 0.2, 0.4))
    good = {p: 0.02 if 0 in votes[p] else 0.98 for p in patterns}
    share, rows = 0.9, [(list(prior[0]), list(prior[1]))] * n_rules

    def probability(p: int) -> float:
        a, b = math.log(share), math.log(1 - share)
        for v, (on_good, on_bad) in zip(votes[p], rows):
            a += math.log(on_good[v])
            b += math.log(on_bad[v])
        return 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))

    for _ in range(rounds if total else 0):
        share = (sum(n * good[p] for p, n in patterns.items()) + 0.9 * weight) / (total + weight)
        rows = []
        for k in range(n_rules):
            tally = [[weight * x for x in side] for side in prior]
            for p, n in patterns.items():
                tally[0][votes[p][k]] += n * good[p]
                tally[1][votes[p][k]] += n * (1 - good[p])
            rows.append(tuple([x / sum(side) for x in side] for side in tally))
        good = {p: probability(p) for p in patterns}
    return [probability(p) for p in range(3**n_rules)], rows


def _fit(patterns: DataFrame, rules) -> list[float]:
    """Probability of good quality by pattern. At most 3**rules rows reach the driver, whatever the corpus."""
    rows = patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    return posteriors({r["pattern"]: r["n"] for r in rows}, len(rules))[0]


def judge(docs: DataFrame, rules=RULES, least: float = 0.5) -> DataFrame:
    """counts() with base_failed, the probability of good quality, and kept."""
    counted = materialize(counts(docs).withColumn("pattern", vote_pattern(F.col, rules)))
    good = F.get(F.lit(_fit(counted, rules)), F.col("pattern"))
    failed = base_failed(F.col)
    return counted.select("*", failed.alias("base_failed"), good.alias("p_good"), (~failed & (good >= least)).alias("kept")).drop("pattern")


def keep_good(docs: DataFrame, rules=RULES, least: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, in the columns of docs.

    Texts are counted once: what the base rules pass is written with its pattern, beside the number of all documents
    for each pattern, and the posteriors then decide on what was written. No document is joined or shuffled.
    """
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _counts(F.col("text")).alias("counts"))

    def count(name: str) -> Column:
        return F.col(f"counts.{name}")

    # Rows that fail anyhow are written without their columns: they count in the pattern alone.
    row = F.when(~base_failed(count), F.col("row"))
    judged = materialize(counted.select(row.alias("row"), vote_pattern(count, rules).alias("pattern")))
    by_pattern = F.lit(_fit(judged.select("pattern"), rules))
    kept = judged.where(F.col("row").isNotNull() & (F.get(by_pattern, F.col("pattern")) >= least))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
