"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated, a posterior decides.

Every text is measured inside its row by built-in functions. A rule turns the measures into a vote: 1 for good, -1 for
bad, 0 if it abstains. Votes are counted per pattern (at most 3 to the power of the number of rules, whatever the size
of the corpus); expectation-maximisation runs over that table and needs no labels. The posterior probability of good
quality, given the votes and the estimated accuracies, replaces a filter in which all rules must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from bladewatch.llm.common import let, own_row, stored, words_of

SYMBOLS = "#*$%&|<>"
MARKS = r"\x21-\x40\x5B-\x60\x7B-\x7E"  # ASCII without letters, which holds SYMBOLS and .!?
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "der", "die", "das", "und", "ist", "nicht", "von",
    "zu", "den", "mit", "le", "la", "les", "et", "des", "un", "une", "que", "en", "est", "de", "el", "los", "y", "se",
)
RULES = ("length", "word_length", "symbols", "lines", "repeats", "stop_words", "letters", "sentences")
ROUNDS = 20
START_ACCURACY, START_PRIOR = 0.8, 0.8  # one vote at the start accuracy is also added to each estimate
ACCURACY_BOUNDS = (0.05, 0.95)  # so that no rule decides alone
PRIOR_BOUNDS = (0.05, 0.95)
KEEP_FROM = 0.5
FEW = 24  # repeated windows up to which looking up beats sorting


def repeated_words(words: Column) -> Column:
    """Words inside a window of three that the text holds at least twice, the first occurrence included.

    Windows are compared by a 64-bit digest inside one text. Most texts repeat none, which one distinct count shows.
    For the others, the places of the repeated digests are looked up one by one if these are few, and else found by
    sorting digests with their places; both ways give the same places.
    """
    digests = let(words, lambda w: F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))

    def twice(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(
            F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())))

    def looked_up(h: Column, d: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i))
        return F.filter(at, lambda i: i.isNotNull())

    def sorted_out(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(
                a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def count(h: Column) -> Column:
        some = let(twice(h), lambda d: F.when(F.size(d) <= FEW, looked_up(h, d)).otherwise(sorted_out(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(some, covered))

    return let(digests, count).cast("long")


def measures(text: Column) -> Column:
    """One struct of whole numbers per text; all are 0 for a null or empty one."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*[F.lit(f(w)) for w in STOP_WORDS for f in (str.lower, str.capitalize)])

    def count(marks: Column, those: str) -> Column:
        return F.length(F.regexp_replace(marks, f"[^{those}]+", "")).cast("long")

    def of(w: Column, l: Column, joined: Column, marks: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            count(marks, SYMBOLS).alias("n_symbols"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(l).cast("long").alias("n_lines"),
            F.size(F.array_intersect(w, stop)).cast("long").alias("n_stop_kinds"),
            F.length(marks).cast("long").alias("n_marks"),
            count(marks, ".!?").alias("n_ends"),
        )

    def with_marks(w: Column, l: Column) -> Column:
        return let(F.array_join(w, ""), lambda j: let(
            F.regexp_replace(j, rf"[^{MARKS}]+", ""), lambda marks: of(w, l, j, marks)))

    return let(words_of(whole), lambda w: let(lines, lambda l: with_marks(w, l)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def votes(m: Column) -> dict[str, Column]:
    """Vote of each rule; whole-number comparisons, so that every engine votes alike."""
    n = m["n_words"]

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    return {
        "length": rule(n < 20, n >= 80),
        "word_length": rule((m["word_chars"] < 2 * n) | (m["word_chars"] > 8 * n),
                            (m["word_chars"] >= 3 * n) & (2 * m["word_chars"] <= 13 * n)),
        "symbols": rule(20 * m["n_symbols"] > n, 100 * m["n_symbols"] <= n),
        "lines": rule((m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]),
                      (m["n_dup_lines"] == 0) & (m["n_lines"] >= 2)),
        "repeats": rule(10 * m["n_repeat_words"] > 3 * n, 10 * m["n_repeat_words"] <= n),
        "stop_words": rule((n >= 30) & (m["n_stop_kinds"] == 0), m["n_stop_kinds"] >= 2),
        "letters": rule(8 * m["n_marks"] > m["word_chars"], 10 * m["n_marks"] <= m["word_chars"]),
        "sentences": rule((n >= 50) & (50 * m["n_ends"] < n), (40 * m["n_ends"] >= n) & (2 * m["n_ends"] <= n)),
    }


def start_accuracies(names) -> dict:
    """Accuracy of each rule's cast votes among (good, bad) texts before any estimate."""
    return {r: (START_ACCURACY, START_ACCURACY) for r in names}


def _log_odds(accuracy: dict, prior: float) -> Column:
    out = F.lit(math.log(prior / (1.0 - prior)))
    for name, (on_good, on_bad) in accuracy.items():
        vote = F.col(f"_v_{name}")
        out = out + F.when(vote == 1, F.lit(math.log(on_good / (1.0 - on_bad)))).when(
            vote == -1, F.lit(math.log((1.0 - on_good) / on_bad))).otherwise(F.lit(0.0))
    return out


def posterior(accuracy: dict, prior: float) -> Column:
    """Probability of good quality from the columns ``_v_<rule>``."""
    return 1.0 / (1.0 + F.exp(-_log_odds(accuracy, prior)))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[dict, float]:
    """Accuracies of each rule's cast votes among good and among bad texts, and the share of good texts, by
    expectation-maximisation over (_v_<rule>..., _n). Abstaining says nothing.

    Accuracy is estimated per class: a rule that calls nearly every text good is right on good texts and wrong on bad
    ones, so its vote weighs next to nothing. The start, rules right more often than wrong, names the classes.
    """
    names = [c[3:] for c in patterns.columns if c.startswith("_v_")]
    accuracy, prior = start_accuracies(names), START_PRIOR
    for _ in range(rounds):
        seen = patterns.withColumn("_p", posterior(accuracy, prior))
        good, bad = F.col("_n") * F.col("_p"), F.col("_n") * (1.0 - F.col("_p"))
        cells = {(r, k, v): F.sum(F.when(F.col(f"_v_{r}") == v, w).otherwise(0.0))
                 for r in names for k, w in enumerate((good, bad)) for v in (-1, 1)}
        sums = seen.agg(F.sum(good), F.sum(bad), *cells.values()).first()
        if sums[0] is None:
            break  # an empty table keeps the start
        of = dict(zip(cells, sums[2:]))
        accuracy = {r: tuple(
            min(max((of[r, k, v] + START_ACCURACY) / (of[r, k, 1] + of[r, k, -1] + 1.0), ACCURACY_BOUNDS[0]),
                ACCURACY_BOUNDS[1]) for k, v in ((0, 1), (1, -1))) for r in names}
        prior = min(max(sums[0] / (sums[0] + sums[1]), PRIOR_BOUNDS[0]), PRIOR_BOUNDS[1])
    return accuracy, prior


def patterns_of(measured: DataFrame, column: str = "_m") -> DataFrame:
    """Counts of each pattern of votes: at most 3 ** rules rows."""
    voted = measured.select(*[v.alias(f"_v_{k}") for k, v in votes(F.col(column)).items()])
    return voted.groupBy(*voted.columns).agg(F.count(F.lit(1)).alias("_n"))


def judged(measured: DataFrame, accuracy: dict, prior: float, column: str = "_m") -> DataFrame:
    """Adds ``base_failed``, ``p_good`` and ``kept``."""
    names = measured.columns
    voted = measured.withColumns({f"_v_{k}": v for k, v in votes(F.col(column)).items()})
    return voted.select(*names, base_failed(F.col(column)).alias("base_failed"), posterior(accuracy, prior).alias("p_good")) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed``, ``p_good`` and ``kept`` of every document, one row per row.

    A null or empty text has no words and fails the base rule; a null id stays null; repeated rows are judged alike
    and each counts in the estimate. Other columns are left out. No rows give no rows.
    """
    measured = stored(docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("_m")))
    accuracy, prior = estimate(stored(patterns_of(measured)))
    return judged(measured, accuracy, prior).select("doc_id", "_m.*", "base_failed", "p_good", "kept")


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that ``quality`` keeps, with their own columns, whatever their names.

    Measures are taken twice, once for the estimate and once for the verdict: that costs a second reading, where
    joining verdicts to documents would shuffle every text.
    """
    measured = measures(F.col(text_col)).alias("_m")
    accuracy, prior = estimate(stored(patterns_of(docs.select(measured))))
    return judged(docs.select(own_row(docs, "_row"), measured), accuracy, prior).filter("kept").select("_row.*")
