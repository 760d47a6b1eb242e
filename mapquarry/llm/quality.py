"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote
patterns (at most 3 ** number of rules, whatever the input) estimates each rule's accuracy on good
and on bad documents; the posterior probability of quality then decides, not an all-must-pass filter.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; an empty
table gives an empty result; repeated rows are judged alike; texts of any length are counted exactly; the
columns kept are packed in a struct, so their names clash with none of the operator's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_rows, words, written

#: Frequent words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on with as be at by this from or an are not "
    "der die und das zu den mit von auf für ist im dem nicht ein eine als auch es "
    "le la les des et en un une que qui dans pour pas sur au avec ce il est du "
    "el los las y de que se por con una para del al lo como su"
).split()

RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "stop_words", "variety", "letters", "shouting")


def features(docs: DataFrame, keep: list[str], place_bits: int = 20) -> DataFrame:
    """doc, the columns keep in a struct, and counts over each whole text.

    n_repeat_words: each 3-word window becomes a long, the upper bits of its hash above and its place
    in the lower place_bits; after one primitive sort equal windows are neighbours, and the gaps
    between the places found give the words covered. Windows are compared by their words. Where two
    neighbours agree in the bits kept but not in their words, others may stand between equal
    ones: such a text's windows are sorted again by whole hashes.
    """
    docs = packed_rows(docs, keep, _t=F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = docs.withColumn("_w", words(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    low = F.when(F.col("n_words") < 2**place_bits, F.lit(2**place_bits - 1)).otherwise(F.lit(2**31 - 1)).cast("long")
    n = F.col("n_words").cast("int")
    at = lambda i: F.get("_w", i)
    whole = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))
    equal = lambda p, q: (at(p) == at(q)) & (at(p + 1) == at(q + 1)) & (at(p + 2) == at(q + 2))
    places = F.sequence(F.lit(0), n - 3)
    packed = F.when(n >= 4, F.transform(places, lambda i: whole(i).bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("_low", low).withColumn("_s", F.sort_array(packed))
    place = lambda x: x.bitwiseAND(F.col("_low")).cast("int")

    def twin(x: Column, j: Column, same: bool = True) -> Column:
        """Whether the windows at x and at place j of the sorted array agree in the bits kept, and in their words (or not in them)."""
        y = F.get("_s", j)
        words_agree = equal(place(x), place(y))
        return F.coalesce(y.isNotNull() & (x.bitwiseXOR(y) <= F.col("_low")) & (x.bitwiseXOR(y) >= 0) & (words_agree if same else ~words_agree), F.lit(False))

    df = df.withColumn("_clash", F.size(F.filter("_s", lambda x, j: twin(x, j + 1, False))) > 0)
    df = df.withColumn("_f", F.when(F.col("_clash"), F.sort_array(F.transform(places, lambda i: F.struct(whole(i).alias("h"), i.alias("i"))))))

    def twin_whole(x: Column, j: Column) -> Column:
        y = F.get("_f", j)
        return F.coalesce((x["h"] == y["h"]) & equal(x["i"], y["i"]), F.lit(False))

    hits = F.transform(F.filter("_s", lambda x, j: twin(x, j + 1) | twin(x, j - 1)), place)
    whole_hits = F.transform(F.filter("_f", lambda x, j: twin_whole(x, j + 1) | twin_whole(x, j - 1)), lambda x: x["i"])
    df = df.withColumn("_p", F.sort_array(F.when(F.col("_clash"), whole_hits).otherwise(hits)))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("long"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumn("_l", lines).select(
        "doc",
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect("_w", F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.regexp_count("_t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def votes(df: DataFrame) -> DataFrame:
    """Adds base_failed and a vote column v_<rule> for each of RULES."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    c = F.col
    rule = {
        "length": _vote(c("n_words") < 20, c("n_words") >= 80),
        "word_length": _vote((c("word_chars") > 12 * n) | (c("word_chars") < 2 * n), c("word_chars").between(3 * n, 9 * n)),
        "symbols": _vote(10 * c("n_symbols") > n, c("n_symbols") * 100 <= n),
        "dup_lines": _vote(10 * c("n_dup_lines") > 3 * c("n_lines"), (c("n_dup_lines") == 0) & (c("n_lines") > 1)),
        "repeats": _vote(10 * c("n_repeat_words") > 3 * n, 20 * c("n_repeat_words") <= n),
        "stop_words": _vote((c("n_stop_words") < 2) & (n >= 20), c("n_stop_words") >= 4),
        "variety": _vote(10 * c("n_distinct") < n, 10 * c("n_distinct") >= 4 * n),
        "letters": _vote(10 * c("n_letters") < 7 * chars, 10 * c("n_letters") >= 9 * chars),
        "shouting": _vote(2 * c("n_upper") > c("n_letters"), 5 * c("n_upper") <= c("n_letters")),
    }
    return df.withColumns({f"v_{k}": v for k, v in rule.items()} | {"base_failed": (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))})


#: Accuracy on good and on bad documents from which the estimate starts.
START = (0.95, 0.3)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300) -> tuple[float, list[tuple[float, float]]]:
    """Prior of quality, and for each rule P(votes good | good, votes) and P(votes bad | bad, votes).

    Votes are taken as independent given the class, and abstaining as uninformative. The start has
    good documents pass 95 % of the votes and bad ones fail 30 % of theirs (a bad document mostly
    breaks a few rules only), which also tells the classes apart; each rule gets two pseudo-votes
    of that kind, and accuracies stay in [0.02, 0.999].
    """
    k = len(patterns[0][0]) if patterns else len(RULES)
    total = sum(n for _, n in patterns)
    prior, acc = 0.8, [START] * k
    for _ in range(rounds if total else 0):
        good_mass, right = 0.0, [[2 * START[0], 2.0, 2 * START[1], 2.0] for _ in range(k)]
        for p, n in patterns:
            g = posterior(p, prior, acc) * n
            good_mass += g
            for i, v in enumerate(p):
                if v:
                    right[i][0] += g * (v > 0)
                    right[i][1] += g
                    right[i][2] += (n - g) * (v < 0)
                    right[i][3] += n - g
        clip = lambda x: min(0.999, max(0.02, x))
        new = [(clip(a / b), clip(c / d)) for a, b, c, d in right]
        new_prior = min(0.99, max(0.01, (good_mass + 1.6) / (total + 2)))
        moved = max(abs(new_prior - prior), *(abs(x - y) for s, t in zip(new, acc, strict=True) for x, y in zip(s, t, strict=True)))
        prior, acc = new_prior, new
        if moved < 1e-9:
            break
    return prior, acc


def _weights(prior: float, acc: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds: of the prior, and what a good and a bad vote of each rule add."""
    return math.log(prior / (1 - prior)), [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in acc]


def posterior(pattern: tuple[int, ...], prior: float, acc: list[tuple[float, float]]) -> float:
    base, add = _weights(prior, acc)
    z = base + sum(g if v > 0 else b for v, (g, b) in zip(pattern, add, strict=True) if v)
    return 1 / (1 + math.exp(-z))


def judge(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds quality_probability and kept to a table with votes; the table is read twice."""
    columns = [f"v_{k}" for k in RULES]
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in df.groupBy(*columns).agg(F.count("*")).collect())
    base, add = _weights(*estimate([(tuple(p), n) for p, n in patterns]))
    z = F.lit(base)
    for name, (good, bad) in zip(columns, add, strict=True):
        z = z + F.when(F.col(name) > 0, F.lit(good)).when(F.col(name) < 0, F.lit(bad)).otherwise(F.lit(0.0))
    p = 1 / (1 + F.exp(-z))
    return df.withColumn("quality_probability", p).withColumn("kept", ~F.col("base_failed") & (p >= threshold))


def quality(docs: DataFrame, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """doc, the columns keep in a struct, with counts, votes, quality_probability and kept.

    Counts and votes are written once to the shared folder; the estimate reads only the votes."""
    return judge(written(votes(features(docs, keep))), threshold)
