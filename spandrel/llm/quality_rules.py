"""Quality rules by weak supervision.

Nine rules each vote good (1), bad (-1) or abstain (0) on a document. Expectation-maximisation estimates how often
each rule says bad about good and about bad documents, and the share of good ones; a document's posterior probability of being good
then replaces the all-must-pass filter. As the rules are independent given the class, the posterior's log odds are a
weighted sum of the votes, so scoring is one projection. EM sees only the histogram of vote patterns, at most 3^9 rows
whatever the corpus.

The rules needn't be right. One that says bad about as often of good documents as of bad ones gets a weight near zero
and is outvoted (v_length is such a rule on prose of any length); one that others confirm gets a large weight. The only
guard is that a rule may not count the wrong way round: where EM finds that it says bad more often of good documents, its
votes have no weight. Half a vote is added on either side, so that no estimate is 0 or 1.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; ties and repeated rows are
scored alike; an empty table gives an empty result; columns of the input whose names clash with the results are
replaced by the results, any other name is allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, stored

#: The same symbol twice, and a line that ends in punctuation.
RUNS = r"##|\*\*|\$\$|%%|&&|\|\||<<|>>"
ENDED = r"[.!?…:;)][\x20\x09]*(?:\n|\z)"
#: Up to so many different repeated windows, a text is searched for each of them.
FEW = 16
ITERATIONS = 40
#: Where EM starts: the chance of being good of a document without a bad vote.
START = 0.9
#: Documents at or above this posterior are kept.
KEEP_FROM = 0.5


def _bound(expr: Column, body) -> Column:
    """body(x) with x evaluated once per row: the optimizer would otherwise copy expr into every use inside a lambda."""
    return F.transform(F.array(expr), body)[0]


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, each word once.

    Sorting the windows' hashes puts equal ones side by side. Where only a few hashes repeat, their positions are found
    by comparing every window with those; where many do, by sorting (hash, position). Both count the same words.
    """

    def covered(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))

    def sorted_positions(s: Column) -> Column:
        last = F.size(s) - 1
        hit = F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])),
        )
        return F.transform(hit, lambda x: x["p"])

    def count(h: Column) -> Column:
        twice = _bound(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))

        def positions(d: Column) -> Column:
            few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i).otherwise(-1)), lambda i: i >= 0)
            keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
            return F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= FEW, _bound(few, covered)).otherwise(_bound(_bound(keyed, sorted_positions), covered))

        return _bound(twice, positions)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_bound(windows(words), count)).cast("long")


FEATURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "n_runs", "n_ended", "n_dup_lines", "n_lines", "n_repeat_words")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with FEATURES (all long), which replace columns of those names."""
    split = fresh(docs, "words")
    t, w = F.coalesce(F.col(text), F.lit("")), F.col(split)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
        "n_runs": F.regexp_count(t, F.lit(RUNS)).cast("long"),
        "n_ended": F.regexp_count(t, F.lit(ENDED)).cast("long"),
        "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": (F.regexp_count(t, F.lit("\n")) + 1).cast("long"),
        "n_repeat_words": _repeated(w),
    }
    kept = [c for c in docs.columns if c not in FEATURES]
    return docs.withColumn(split, F.filter(F.split(t, SPACE + "+"), lambda x: x != "")).select(*kept, *[v.alias(k) for k, v in found.items()])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's vote, over the columns of features(). Integer comparisons only, so that no rounding decides."""
    n, enough = F.col("n_words"), F.col("n_words") >= 20
    return {
        "v_length": _vote(n < 80, n >= 150),
        "v_symbols": _vote(10 * F.col("n_symbols") > n, 50 * F.col("n_symbols") <= n),
        "v_lines": _vote((F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")), (F.col("n_lines") >= 2) & (10 * F.col("n_dup_lines") <= F.col("n_lines"))),
        "v_word_size": _vote((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n), (F.col("word_chars") >= 3 * n) & (F.col("word_chars") <= 10 * n) & enough),
        "v_repeats": _vote(20 * F.col("n_repeat_words") > 9 * n, (5 * F.col("n_repeat_words") <= n) & enough),
        "v_capitals": _vote(10 * F.col("n_upper") > 3 * F.col("word_chars"), (10 * F.col("n_upper") <= F.col("word_chars")) & enough),
        "v_letters": _vote(25 * F.col("n_letters") < 22 * F.col("word_chars"), (20 * F.col("n_letters") >= 19 * F.col("word_chars")) & enough),
        "v_runs": _vote(20 * F.col("n_runs") > n, (F.col("n_runs") == 0) & enough),
        "v_endings": _vote(2 * F.col("n_ended") < F.col("n_lines"), (10 * F.col("n_ended") >= 9 * F.col("n_lines")) & enough),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS) -> tuple[float, list[float], list[float]]:
    """EM over (votes, number of documents): the share of good documents, and how often each rule that votes says bad
    about good and about bad documents. It starts from the belief that a bad vote makes a document suspect, the more so the fewer the rule calls bad."""
    k = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    prior, on_good, on_bad = 0.5, [0.5] * k, [0.5] * k
    called = [[(n, votes[j] < 0) for votes, n in patterns if votes[j]] for j in range(k)]
    against = [min(0.0, math.log(2 * (sum(n for n, no in x if no) + 0.5) / (sum(n for n, _ in x) + 1))) for x in called]
    belief = [1 / (1 + math.exp(-(math.log(START / (1 - START)) + sum(a for v, a in zip(votes, against, strict=True) if v < 0)))) for votes, _ in patterns]
    for _ in range(iterations):
        prior = (sum(n * q for (_, n), q in zip(patterns, belief, strict=True)) + 0.5) / (total + 1)
        for j in range(k):
            said = [(n, q, votes[j] < 0) for (votes, n), q in zip(patterns, belief, strict=True) if votes[j]]
            good, good_no = sum(n * q for n, q, _ in said), sum(n * q for n, q, no in said if no)
            bad, bad_no = sum(n * (1 - q) for n, q, _ in said), sum(n * (1 - q) for n, q, no in said if no)
            on_good[j], on_bad[j] = (good_no + 0.5) / (good + 1), (bad_no + 0.5) / (bad + 1)
            if on_bad[j] <= on_good[j]:
                on_good[j] = on_bad[j] = (good_no + bad_no + 0.5) / (good + bad + 1)
        belief = [1 / (1 + math.exp(-log_odds(votes, prior, on_good, on_bad))) for votes, _ in patterns]
    return prior, on_good, on_bad


def weights(on_good: float, on_bad: float) -> tuple[float, float]:
    """What a good and a bad vote add to the log odds of being good."""
    return math.log((1 - on_good) / (1 - on_bad)), math.log(on_good / on_bad)


def log_odds(votes: tuple[int, ...], prior: float, on_good: list[float], on_bad: list[float]) -> float:
    return math.log(prior / (1 - prior)) + sum(weights(g, b)[v < 0] for v, g, b in zip(votes, on_good, on_bad, strict=True) if v)


def quality_rules(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (all but the text when None), the features, votes, base_failed, log_odds, posterior and kept."""
    votes = list(rules())
    ours = {*FEATURES, *votes, "base_failed", "log_odds", "posterior", "kept"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ours and (carry is not None or c != text)]
    given = docs.select(*[F.col(c).alias(f"in_{c}") for c in dict.fromkeys([*carry, text])])
    found = stored(features(given, f"in_{text}").select(*[f"in_{c}" for c in carry], *FEATURES).withColumns(rules()), "quality")
    # at most 3^9 patterns, whatever the number of documents
    seen = found.groupBy(*votes).count().collect()
    prior, on_good, on_bad = fit(sorted((tuple(r[v] for v in votes), r["count"]) for r in seen))
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, g, b in zip(votes, on_good, on_bad, strict=False):
        up, down = weights(g, b)
        odds = odds + F.when(F.col(v) > 0, up).when(F.col(v) < 0, down).otherwise(0.0)
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    out = found.withColumn("base_failed", (n < 50) | (100 * rep > 50 * n)).withColumn("log_odds", odds)
    out = out.withColumn("posterior", 1 / (1 + F.exp(-F.col("log_odds"))))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))
    return out.select(*[F.col(f"in_{c}").alias(c) for c in carry], *FEATURES, *votes, "base_failed", "log_odds", "posterior", "kept")
