"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one statistic of a text and votes good, bad or abstains. Votes of all documents
collapse to at most 3 ** len(RULES) patterns with counts; expectation-maximisation over that table
estimates how often each rule votes bad on bad and on good documents, and every document gets the
posterior probability that it is good. An abstention says nothing.

What a rule is for bounds its rates: it votes bad on at most one good document in a hundred and on
at least one bad one in twenty, and at least half of all documents are good. Without labels, nothing
else tells the good side from the bad; where an estimate lies on a bound, the bound decides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import documents, written

WINDOW = 8
#: name: (statistic, bad where, good where), over columns of ``measured``.
RULES = {
    "word_length": ("word_chars / n_words", "v < 2.0 or v > 14.0", "v between 2.5 and 11.0"),
    "symbols": ("n_symbols / n_words", "v > 0.3", "v < 0.05"),
    "duplicate_lines": ("n_dup_lines / n_lines", "v > 0.45", "v < 0.1"),
    "repeated_words": ("n_repeat_words / n_words", "v > 0.28", "v < 0.05"),
    "capitals": ("n_upper / word_chars", "v > 0.4", "v < 0.15"),
    "exclamations": ("n_bangs / n_words", "v > 0.2", "v < 0.05"),
    "distinct_words": ("if(n_words >= 40, n_distinct / n_words / least(1.0, 6 / ln(n_words)), null)", "v < 0.15", "v > 0.3"),
    "sentences": ("n_stops / n_words", "v < 0.004 and n_words > 100", "v between 0.02 and 0.3"),
}
START_BAD, START_GOOD, PRIOR = 0.3, 0.004, 0.9
#: Least change of a rate, or of the share of good documents, that asks for another round.
LEAST_CHANGE = 1e-6
#: A rule votes bad on at most GOOD_MOST of good documents and on at least BAD_LEAST of bad ones; the share of good ones is in SHARE.
GOOD_MOST, BAD_LEAST, SHARE = 0.01, 0.05, (0.5, 0.99)


def _repeated(window: int) -> str:
    """Words covered by windows whose hash is in ``h`` twice; h: hashes of all windows in order."""
    return f"""element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
        aggregate(sort_array(transform(filter(s, (e, k) -> coalesce(get(s, k - 1).x = e.x, false) OR coalesce(get(s, k + 1).x = e.x, false)), e -> e.i)),
            struct(0L AS n, 0 AS upto), (a, p) -> struct(a.n + least({window}, p + {window} - a.upto) AS n, p + {window} AS upto), a -> a.n)), 1)"""


def measured(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the counts that rules use, for every row of ``docs``; a null text is an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    flat = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    rows = rows.withColumn("words", F.array_remove(F.split(flat, " "), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    rows = rows.withColumn("lines", lines).withColumn("n_words", F.size("words").cast("long"))
    hashes = f"if(n_words > {window}, transform(sequence(1, int(n_words) - {window - 1}), i -> xxhash64(slice(words, i, {window}))), cast(array() as array<bigint>))"
    rows = rows.withColumn("h", F.expr(hashes))
    gone = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    return rows.select(
        "doc_id", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), gone(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr(_repeated(window))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), gone("[A-Z]+").alias("n_upper"), (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).alias("n_bangs"),
        (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).alias("n_stops"), F.size(F.array_distinct("words")).alias("n_distinct"),
    )


def votes(stats: DataFrame, rules: dict = RULES) -> DataFrame:
    """Adds vote_<rule>: 1 good, -1 bad, 0 abstained (also where a statistic is null)."""
    for name, (value, bad, good) in rules.items():
        told = F.expr(f"transform(array(if(n_words > 0, {value}, null)), v -> CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END)[0]")
        stats = stats.withColumn(f"vote_{name}", told)
    return stats


def log_odds(names: list[str], prior: float, bad: dict[str, tuple[float, float]]) -> str:
    """SQL for the log odds that a document is good; bad: P(bad vote) given good and given bad."""
    terms = [repr(math.log(prior / (1 - prior)))]
    for r in names:
        g, b = bad[r]
        terms.append(f"CASE vote_{r} WHEN -1 THEN {math.log(g / b)!r} WHEN 1 THEN {math.log((1 - g) / (1 - b))!r} ELSE 0D END")
    return " + ".join(f"({t})" if t[0] == "-" else t for t in terms)


def estimated(patterns: list[tuple[tuple[int, ...], int]], names: list[str]) -> tuple[float, dict[str, tuple[float, float]]]:
    """Share of good documents and each rule's rates, by expectation-maximisation over (votes, n).

    There are at most 3 ** len(names) patterns whatever the number of documents, so the sums are
    taken on the driver, with no job for each round. A round takes the likeliest values within
    GOOD_MOST, BAD_LEAST and SHARE, given a few assumed votes: so no rule changes sides, and the
    likelihood rises until no value moves by LEAST_CHANGE. No round is the last before that. With no
    patterns, the values are those it starts from.
    """
    prior, bad = PRIOR, {r: (START_GOOD, START_BAD) for r in names}
    total, moved = sum(n for _, n in patterns), 1.0 if patterns else 0.0
    while moved >= LEAST_CHANGE:
        told = [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in map(bad.get, names)]
        start, share = math.log(prior / (1 - prior)), 0.0
        sums = [[0.0] * 4 for _ in names]
        for vote, n in patterns:
            odds = start + sum(t[v > 0] for t, v in zip(told, vote) if v)
            good = n / (1 + math.exp(-odds))
            share += good
            for s, v in zip(sums, vote):
                if v:
                    s[0] += good
                    s[1] += n - good
                    if v < 0:
                        s[2] += good
                        s[3] += n - good
        rates = {r: (min((gm + 0.3) / (gv + 10), GOOD_MOST), max((bm + 3) / (bv + 10), BAD_LEAST)) for r, (gv, bv, gm, bm) in zip(names, sums)}
        new = min(max((share + 9) / (total + 10), SHARE[0]), SHARE[1])
        moved = max([abs(new - prior), *(abs(x - y) for r in names for x, y in zip(rates[r], bad[r]))])
        prior, bad = new, rates
    return prior, bad


def quality_rules(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """Counts, base_failed, quality (posterior) and kept for every row of ``docs`` (doc_id, text).

    A text of fewer than 20 words, or with over 30 % of its words in repeated windows, fails
    outright; others are kept if the posterior is at least one half. Null and empty texts have no
    words and fail. A null id is carried through; equal rows are judged alike; other columns are
    ignored. On an empty table nothing is estimated and nothing returned.
    """
    names = list(rules)
    stats = written(votes(measured(docs), rules), "votes")
    columns = [f"vote_{r}" for r in names]
    # what fails outright needs no vote
    counted = stats.where("n_words >= 20 and 100 * n_repeat_words <= 30 * n_words").groupBy(*columns).count().collect()
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in counted)
    prior, bad = estimated(patterns, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = F.expr(f"1 / (1 + exp(-({log_odds(names, prior, bad)})))")
    done = stats.withColumn("base_failed", failed).withColumn("quality", quality)
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("n_lines", "n_upper", "n_bangs", "n_stops", "n_distinct")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by all rules."""
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
