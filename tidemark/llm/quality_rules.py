"""Quality rules: fixed base rules and a decision list learned from labelled statistics.

Every text gets counts (words, symbols, repeated lines, repeated word triples, capitals and so on), all as DataFrame
expressions. Sequential covering learns on labelled documents: a rule grows by adding the threshold that gains most, is
pruned on held-out rows, and is kept if it is precise there; the rows that it covers leave, and the next rule follows. The
rules become one chain of Spark conditions.

Learning takes `fit_rows` labelled documents at most (those with the smallest hash of their doc_id; 20,000 by default,
a few MB of numbers). Without labels no rule is learned, and only the base rules reject.

Null text has no words; such a document fails the base rules. Word triples and lines of a text are compared by 64-bit hashes
and whole, respectively. Labels that are null, or that differ for one document, are not used. Repeated rows are judged each for
itself, alike. Columns of any name can come along in a struct: `docs.select(F.struct("*").alias("row"), "text")`; as columns of
their own they must not be named as the counts are. An empty table gives no rows.
"""

from __future__ import annotations

from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 20_000
#: Smallest share of bad documents among the held-out rows that a rule covers, and smallest number of them.
PRECISION, LEAST = 0.97, 5
MOST_CONDITIONS, MOST_RULES = 4, 12
CUTS = 32
WHITE = " \t\n\x0b\x0c\r"
_WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS, DIGITS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?"
MIN_WORDS, MOST_REPEAT_PERCENT = 50, 50
#: Above so many distinct repeated triples, their places are found by sorting.
FEW_REPEATS = 32

#: Learned thresholds are on these.
FEATURES = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "digit_share", "mark_share", "words_per_line"]


def _count(characters: str) -> Column:
    return (F.length("text") - F.length(F.translate("text", characters, ""))).cast("long")


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, F.lit(by + 1), F.greatest(F.size(name) - by, F.lit(0)))


def statistics(docs: DataFrame) -> DataFrame:
    """All other columns of docs(text), and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more counts."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim("text", F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE_RUN))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    counted = docs.withColumns({
        "_words": words, "_lines": lines,
        "word_chars": F.length(F.translate("text", WHITE, "")).cast("long"),
        "n_symbols": _count(SYMBOLS), "n_capitals": _count(CAPITALS), "n_digits": _count(DIGITS), "n_marks": _count(MARKS),
    }).drop("text")
    hashed = counted.withColumns({
        "n_words": F.size("_words").cast("long"), "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_words", "_lines")
    # Triples: of three shifted lists the last two places of the longest have no partner.
    pairs = F.zip_with("_hashes", _shifted("_hashes", 1), lambda a, b: F.xxhash64(a, b))
    triples = F.slice(F.zip_with(pairs, _shifted("_hashes", 2), lambda p, c: F.xxhash64(p, c)), F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0)))
    hashed = hashed.withColumn("_triples", triples).drop("_hashes")
    hashed = hashed.withColumn("_sorted", F.when(F.size(F.array_distinct("_triples")) < F.size("_triples"), F.sort_array("_triples")).otherwise(F.array().cast("array<long>")))
    equal = F.zip_with("_sorted", _shifted("_sorted", 1), lambda a, b: F.when(a == b, a))
    hashed = hashed.withColumn("_repeated", F.array_distinct(F.filter(equal, lambda x: x.isNotNull()))).drop("_sorted")
    few = F.filter(F.transform("_triples", lambda h, i: F.when(F.array_contains("_repeated", h), i)), lambda i: i.isNotNull())
    # Many repeats: (triple, place) sorted; a place counts if a neighbour has the same triple.
    hashed = hashed.withColumn("_placed", F.when(F.size("_repeated") > FEW_REPEATS, F.sort_array(F.transform("_triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")))
    next_same = F.zip_with("_placed", _shifted("_placed", 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    many = F.flatten(F.filter(next_same, lambda x: x.isNotNull()))
    hashed = hashed.withColumn("_at", F.when(F.size("_repeated") == 0, F.array().cast("array<int>")).when(F.size("_repeated") <= FEW_REPEATS, few).otherwise(many))
    covered = F.array_distinct(F.concat("_at", F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2)))
    out = hashed.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("_triples", "_repeated", "_placed", "_at")
    return out


def features() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "capital_share": share("n_capitals", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"), "words_per_line": share("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


Rule = list[tuple[str, str, float]]


def _matches(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for name, side, cut in rule:
        hit &= x[name] <= cut if side == "<=" else x[name] >= cut
    return hit


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held_out: np.ndarray) -> list[Rule]:
    """Sequential covering: ordered rules, each a conjunction of thresholds that marks bad rows."""
    names, n = list(x), len(bad)
    cuts = {f: np.unique(np.quantile(x[f], np.linspace(0, 1, CUTS + 1))) if n else [] for f in names}
    left, rules = np.ones(n, bool), []
    while len(rules) < MOST_RULES and (left & bad & ~held_out).any():
        grow, rule = left & ~held_out, []
        covered = grow.copy()
        while len(rule) < MOST_CONDITIONS and (covered & ~bad).any():
            p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
            best = (1e-9, None)
            for f in names:
                own, own_bad = x[f][covered], bad[covered]
                for side in ("<=", ">="):
                    for cut in cuts[f]:
                        hit = own <= cut if side == "<=" else own >= cut
                        p = int((hit & own_bad).sum())
                        if p == 0:
                            continue
                        gain = p * (log2(p / int(hit.sum())) - log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (f, side, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
            covered = grow & _matches(rule, x, n)
        rule = _pruned(rule, x, bad, left & held_out)
        hit = _matches(rule, x, n) & left
        judged = hit & held_out
        p, q = int((judged & bad).sum()), int((judged & ~bad).sum())
        if not rule or p < LEAST or p / (p + q) < PRECISION or (hit & ~bad & ~held_out).sum() > (1 - PRECISION) * max(1, (hit & ~held_out).sum()):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """The prefix of the rule with the best (bad - good) / covered on the held-out rows; ties to the longer one."""
    best, kept = -2.0, rule
    for k in range(len(rule), 0, -1):
        hit = _matches(rule[:k], x, len(bad)) & rows
        p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - q) / (p + q) if p + q else -1.0
        if worth > best:
            best, kept = worth, rule[:k]
    return kept


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn rules that mark documents with quality 0, among those that pass the base rules."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    sample = one.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) == 0
    told = statistics(rows).withColumns(features()).select(*FEATURES, base_failed().alias("failed"), (F.col("quality") == 0).alias("bad"), held.alias("held")).collect()
    told = sorted((r for r in told if not r["failed"]), key=tuple)
    x = {f: np.array([float(r[f]) for r in told]) for f in FEATURES}
    return learn(x, np.array([r["bad"] for r in told], bool), np.array([r["held"] for r in told], bool))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one expression: true keeps."""
    chain = None
    for rule in rules:
        test = F.lit(True)
        for name, side, cut in rule:
            test = test & (F.col(name) <= cut if side == "<=" else F.col(name) >= cut)
        chain = F.when(test, False) if chain is None else chain.when(test, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """statistics(docs) with base_failed and kept.

    The observed counts also keep the optimizer from copying the statistics into a filter on `kept`, several times each.
    """
    out = statistics(docs).withColumns(features()).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.observe("quality_rules", F.count(F.lit(1)).alias("documents"), F.count_if("kept").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, common.read(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERY = ("op9_quality_rules", query, None)
