"""Mixing by iterative proportional fitting (raking).

Token weights of the cells source x language x topic are raked to target marginals of each; then
each document is sampled with its cell's calibrated probability. Cells with fewer tokens than their
share demands are taken whole and the rest is raised in proportion, so the budget is met. Topics are
a column of the table or are found by clustering (see topics.py).

Defined cases: null source, language or topic is a group of its own ("" in the result); null and empty
texts have no tokens and are never sampled; repeated rows share one draw; very long texts count all
their words; an empty table gives an empty result; the columns kept are packed in a struct, so their
names clash with none of the operator's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import topics
from .common import packed_rows, words, written

DIMS = ("source", "lang", "topic")


def tempered(tokens: Mapping[str, float], power: float) -> dict[str, float]:
    """Shares proportional to tokens ** power: below 1 lifts small groups."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: Mapping[tuple, float], targets: Sequence[Mapping[str, float]], rounds: int = 500, tolerance: float = 1e-10) -> dict[tuple, float]:
    """Weights with the targets' marginal shares and the cells' interaction; they sum to 1."""
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items() if v > 0} if total else {}
    for _ in range(rounds):
        worst = 0.0
        for d, target in enumerate(targets):
            have: dict[str, float] = defaultdict(float)
            for k, v in w.items():
                have[k[d]] += v
            mass = sum(target.get(k, 0.0) for k in have)
            if not mass:
                continue
            factor = {k: target.get(k, 0.0) / mass / v if v else 0.0 for k, v in have.items()}
            worst = max([worst, *(abs(f - 1) for f in factor.values())])
            w = {k: v * factor[k[d]] for k, v in w.items()}
        if worst < tolerance:
            break
    return w


def probabilities(cells: Mapping[tuple, float], weights: Mapping[tuple, float], budget: float) -> dict[tuple, float]:
    """Sampling probability of each cell, for budget tokens in expectation."""
    left, open_, p = min(budget, sum(cells.values())), {k for k, v in weights.items() if v > 0}, dict.fromkeys(cells, 0.0)
    while open_ and left > 0:
        mass = sum(weights[k] for k in sorted(open_))
        full = {k for k in open_ if left * weights[k] / mass >= cells[k]}
        if not full:
            p.update({k: left * weights[k] / mass / cells[k] for k in open_})
            break
        p.update(dict.fromkeys(full, 1.0))
        left -= sum(cells[k] for k in sorted(full))
        open_ -= full
    return p


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), share: float = 0.5, powers: Sequence[float] = (0.7, 0.8, 0.5), targets: Sequence[Mapping[str, float]] | None = None, topic: Column | None = None, n_topics: int = 8, seed: int = 17, max_cells: int = 1_000_000) -> DataFrame:
    """doc, the columns keep in a struct, with mix_source, mix_lang, mix_topic, n_tokens, weight, probability, selected.

    topic: an expression, else the column topic, else n_topics clusters. targets: shares by source,
    language and topic; left out, the tokens' own shares tempered by powers. share: of all tokens,
    how many to sample. The cell table is summed over all documents; it is fitted on the driver, and
    more than max_cells cells raise an error before they are sent.
    """
    group = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    text = F.col("text").cast("string")
    if topic is None and "topic" in docs.columns:
        topic = F.col("topic")
    found = {"sketch": topics.sketched(text)} if topic is None else {"mix_topic": group(topic), "n_tokens": F.size(words(text)).cast("long")}
    df = written(packed_rows(docs, list(keep), id=F.col("doc_id"), mix_source=group(F.col("source")), mix_lang=group(F.col("lang")), **found))
    if topic is None:
        df = topics.with_topics(df, "mix_topic", "mix_lang", n_topics).withColumn("n_tokens", F.get("sketch", F.lit(0)))
    names = [f"mix_{d}" for d in DIMS]
    rows = df.groupBy(*names).agg(F.sum("n_tokens").alias("n")).limit(max_cells + 1).collect()
    if len(rows) > max_cells:
        raise ValueError(f"more than {max_cells} cells of source, language and topic; coarsen them or raise max_cells")
    cells = {tuple(r[:3]): float(r[3]) for r in sorted(rows, key=lambda r: tuple(r[:3]))}
    if targets is None:
        targets = []
        for d, power in enumerate(powers):
            sums: dict[str, float] = defaultdict(float)
            for k, v in cells.items():
                sums[k[d]] += v
            targets.append(tempered(sums, power))
    weights = rake(cells, targets)
    p = probabilities(cells, weights, share * sum(cells.values()))
    fitted = df.sparkSession.createDataFrame([(*k, float(weights.get(k, 0.0)), float(v)) for k, v in p.items()], ", ".join(f"{n} string" for n in names) + ", weight double, probability double")
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
    out = df.join(fitted, names, "left") if len(p) > 20_000 else df.join(F.broadcast(fitted), names, "left")
    return out.select("doc", *names, "n_tokens", "weight", "probability", ((F.col("n_tokens") > 0) & (u < F.col("probability"))).alias("selected"))
