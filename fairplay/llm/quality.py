"""Quality by weak supervision: rules vote, a label model weighs them.

Eight rules look at a text and vote good (1), bad (-1) or abstain (0) between their
two thresholds. Nobody knows the truth, so expectation-maximisation estimates it
together with the rules: given each rule's accuracies on good and on bad texts, the
posterior probability that a text is good follows from its votes (independent given
the truth, abstentions say nothing); given the posteriors, a rule's accuracies are the
shares of its votes that agree with them. A text is kept if its posterior reaches one
half, instead of passing every rule. A rule that rarely errs against the others on
good texts convicts alone; one that errs often only adds to others' votes.

Main path: SQL functions only. Votes are first counted by pattern (at most 3 ** 8
rows, map-side), and each round is one aggregate over the patterns, so the cost of
the fit does not depend on the number of documents or on how many share a pattern.

Cases: null and empty texts have no words, fail the base and are not kept; repeated
rows vote each; an empty table gives an empty table; texts are read whole; other
columns pass through ``keep`` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairplay.llm.common import WORD, write_table
from fairplay.session import cut_lineage

#: Frequent function words of the languages in the corpus.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "der", "die", "und", "das", "ist", "le", "la", "de", "et",
              "les", "des", "que", "el", "los", "en", "un", "una", "une")
#: Rule -> (SQL of good, SQL of bad) over the measures below; neither: it abstains.
RULES = {
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "word_length": ("word_chars between 3.5 * n_words and 5.8 * n_words", "word_chars < 2.5 * n_words or word_chars > 6.5 * n_words"),
    "lines": ("n_dup_lines = 0 and n_lines > 1", "4 * n_dup_lines > n_lines"),
    "repetition": ("n_words >= 50 and 10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "line_ends": ("10 * n_ended_lines >= 9 * n_lines and n_lines > 0", "10 * n_ended_lines < 6 * n_lines"),
    "letters": ("100 * n_letters >= 76 * n_chars and n_chars > 0", "100 * n_letters < 70 * n_chars"),
    "stop_words": ("n_stop_words >= 3", "n_stop_words = 0 and n_words >= 50"),
    "variety": ("n_words >= 50 and 2 * n_distinct >= n_words", "n_words >= 50 and 4 * n_distinct < n_words"),
}
ENDED = r"[.!?:\"][\x20\x09-\x0D]*$"
ROUNDS = 20
START, PRIOR, SMOOTH, SURE = (0.95, 0.5), 0.8, 5.0, 0.999
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters",
            "n_chars", "n_stop_words", "n_distinct")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``__m`` of the measures."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda what: F.length(F.regexp_replace(t, what, ""))
    a = df.withColumn("__w", F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)))
    a = a.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    # 3-word windows as (hash, place), sorted: equal ones are neighbours
    a = a.withColumn("__g", F.when(F.size("__w") >= 3, F.sort_array(F.transform(
        F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)).alias("g"), i.alias("i"))))))
    a = a.withColumn("__i", F.sort_array(F.transform(F.filter(
        "__g", lambda x, i: (x["g"] == F.get("__g", i - 1)["g"]) | (x["g"] == F.get("__g", i + 1)["g"])), lambda x: x["i"])))
    covered = F.aggregate(  # places are ascending; each window covers three words
        "__i", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")))["n"]
    a = a.withColumn("__e", F.size(F.filter("__l", lambda x: x.rlike(ENDED))))
    counts = {
        "n_words": F.size("__w"),
        "word_chars": without(r"[\x20\x09-\x0D]+"),
        "n_symbols": F.length(t) - without(r"[#*$%&|<>]+"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("__l"),
        "n_ended_lines": F.col("__e"),
        "n_letters": F.length(t) - without(r"\p{L}+"),
        "n_chars": F.length(t),
        "n_stop_words": F.size(F.array_intersect("__w", F.array(*map(F.lit, STOP_WORDS)))),
        "n_distinct": F.size(F.array_distinct("__w")),
    }
    # the number beside the measures keeps conditions on them above this step, where they are columns
    a = a.withColumns({"__m": F.struct(*[c.cast("long").alias(n) for n, c in counts.items()]), "__n": F.monotonically_increasing_id()})
    return a.filter("__n >= 0").drop("__w", "__l", "__g", "__i", "__e", "__n")


def votes(m: DataFrame) -> DataFrame:
    """A table with the measures -> with a column ``v_<rule>`` of -1, 0 or 1 each."""
    return m.withColumns({f"v_{r}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end")
                          for r, (good, bad) in RULES.items()})


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def posterior(prior: float, accuracy: dict[str, tuple[float, float]]) -> Column:
    """Probability of good, from the columns of votes."""
    logit = F.lit(math.log(prior / (1 - prior)))
    for r, (good, bad) in accuracy.items():
        logit = logit + F.expr(f"case v_{r} when 1 then {math.log(good / (1 - bad))!r}D when -1 then {math.log((1 - good) / bad)!r}D else 0D end")
    return 1 / (1 + F.exp(-logit))


def fit(voted: DataFrame) -> tuple[float, dict[str, tuple[float, float]]]:
    """(prior, accuracies of each rule on good and on bad texts) by expectation-maximisation
    over the vote patterns."""
    names = [f"v_{r}" for r in RULES]
    patterns = cut_lineage(voted.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")))
    patterns = cut_lineage(patterns.coalesce(1))  # at most 3 ** 8 rows by now: a round is one task
    prior, accuracy = PRIOR, dict.fromkeys(RULES, START)
    limit = lambda x: min(max(x, 1 - SURE), SURE)
    for _ in range(ROUNDS):
        p = patterns.withColumn("p", posterior(prior, accuracy))
        sums = p.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good"), *[
            F.sum(F.expr(f"case when v_{r} = {v} then n * {w} else 0D end")).alias(f"{r}{v}{w}")
            for r in RULES for v, w in ((1, "p"), (-1, "p"), (1, "(1 - p)"), (-1, "(1 - p)"))]).first()
        if not sums["n"]:
            break
        prior = limit(sums["good"] / sums["n"])
        share = lambda hit, other, start: limit((hit + SMOOTH * start) / (hit + other + SMOOTH))
        accuracy = {r: (share(sums[f"{r}1p"], sums[f"{r}-1p"], START[0]),
                        share(sums[f"{r}-1(1 - p)"], sums[f"{r}1(1 - p)"], START[1])) for r in RULES}
    return prior, accuracy


def judged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures, votes, base_failed, posterior, kept) of every row. Measures are taken once."""
    measures = write_table(measured(df.select(F.col(key), F.col(text).alias("__t")), "__t").select(key, "__m.*"), "quality")
    voted = votes(measures)
    p = posterior(*fit(voted))
    return voted.withColumn("base_failed", base_failed()).withColumn("posterior", p).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, in its columns. Texts are measured twice and not shuffled."""
    prior, accuracy = fit(votes(measured(df.select(F.col(text).alias("__t")), "__t").select("__m.*")))
    rows = measured(df, text)
    names = {n: F.col(f"__m.{n}") for n in MEASURES}
    verdict = votes(rows.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), *[c.alias(n) for n, c in names.items()]))
    return verdict.filter(~base_failed() & (posterior(prior, accuracy) >= 0.5)).select("__row.*")
