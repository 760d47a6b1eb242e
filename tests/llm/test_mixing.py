import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mapquarry.llm import mixing

from .helpers import docs


def marginals(weights, d):
    out = defaultdict(float)
    for k, v in weights.items():
        out[k[d]] += v
    return dict(out)


def test_rake_meets_all_marginals():
    r = random.Random(4)
    cells = {(a, b, c): r.randint(1, 900) for a in "xyz" for b in "pq" for c in "uvw"}
    targets = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.9, "q": 0.1}, {"u": 0.2, "v": 0.2, "w": 0.6}]
    w = mixing.rake(cells, targets)
    for d, t in enumerate(targets):
        assert marginals(w, d) == pytest.approx(t, abs=1e-8)
    ratio = lambda m, c: m["x", "p", c] * m["y", "q", c] / m["x", "q", c] / m["y", "p", c]
    assert ratio(w, "u") == pytest.approx(ratio(cells, "u"))  # interactions stay


def test_probabilities_meet_the_budget():
    cells, weights = {"a": 100.0, "b": 1000.0, "c": 10.0, "d": 5.0}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}
    p = mixing.probabilities(cells, weights, 400)
    assert p["c"] == 1.0 and p["a"] == 1.0 and p["d"] == 0
    assert sum(p[k] * cells[k] for k in cells) == pytest.approx(400)
    assert mixing.probabilities(cells, weights, 1e9)["b"] == 1.0


def test_documents(spark):
    r = random.Random(9)
    rows = [(k, "w " * r.randint(1, 60), r.choice(["en", "de"]), r.choice(["hot"] * 8 + ["s1", "s2"])) for k in range(3000)]
    rows += [(5000, None, "en", "hot"), (5001, "", None, None), (None, "a b c", None, "s1"), (7, rows[7][1], rows[7][2], rows[7][3])]
    targets = [{"hot": 0.4, "s1": 0.3, "s2": 0.3}, {"en": 0.5, "de": 0.5}, {"t": 1.0}]
    got = mixing.mix(docs(spark, rows), share=0.3, targets=targets, topic=F.lit("t")).collect()
    assert len(got) == len(rows)
    taken = [x for x in got if x.selected]
    total = sum(x.n_tokens for x in taken)
    assert total == pytest.approx(0.3 * sum(x.n_tokens for x in got), rel=0.07)
    share = defaultdict(float)
    for x in taken:
        share[x.mix_source] += x.n_tokens / total
    assert share["hot"] == pytest.approx(0.4, abs=0.05) and share["s1"] == pytest.approx(0.3, abs=0.05)
    assert not any(x.selected for x in got if x.doc.doc_id in (5000, 5001))
    again = {x.doc.doc_id for x in mixing.mix(docs(spark, rows), share=0.3, targets=targets, topic=F.lit("t")).collect() if x.selected}
    assert again == {x.doc.doc_id for x in taken}


def test_against_brute_force(spark):
    """Every document's weight, probability and draw, computed plainly from the definition."""
    import numpy as np
    from xxhash import xxh64_intdigest

    r = random.Random(12)
    rows = [(k * 7 - 900, "w " * r.randint(0, 40), r.choice(["en", "de", None]), r.choice(["hot"] * 8 + ["s1", None])) for k in range(600)]
    frame = docs(spark, rows).withColumn("topic", F.when(F.pmod("doc_id", F.lit(3)) == 0, "x").when(F.pmod("doc_id", F.lit(3)) == 1, "y"))
    got = {x.doc.doc_id: x for x in mixing.mix(frame, share=0.4).collect()}
    key = {i: (s or "", la or "", {0: "x", 1: "y"}.get(i % 3, "")) for i, _, la, s in rows}
    tokens = {i: len(t.split()) for i, t, _, _ in rows}
    axes = [sorted({k[d] for k in key.values()}) for d in range(3)]
    at = {i: tuple(axes[d].index(k[d]) for d in range(3)) for i, k in key.items()}
    cells = np.zeros([len(a) for a in axes])
    for i, n in tokens.items():
        cells[at[i]] += n
    w = cells / cells.sum()
    other = [(1, 2), (0, 2), (0, 1)]
    target = [cells.sum(axis=o) ** p / (cells.sum(axis=o) ** p).sum() for o, p in zip(other, (0.7, 0.8, 0.5), strict=True)]
    for _ in range(2000):
        for d in range(3):
            shape = [-1 if k == d else 1 for k in range(3)]
            w = w * (target[d] / w.sum(axis=other[d])).reshape(shape)
    # the share s of the budget at which min(1, s * weight / tokens) of all tokens meet it
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        p = np.minimum(1, mid * w / np.maximum(cells, 1e-9)) * (cells > 0)
        low, high = (mid, high) if (p * cells).sum() < 0.4 * cells.sum() else (low, mid)
    for i, n in tokens.items():
        x = got[i]
        assert (x.mix_source, x.mix_lang, x.mix_topic, x.n_tokens) == (*key[i], n)
        assert x.weight == pytest.approx(w[at[i]], rel=1e-6) and x.probability == pytest.approx(p[at[i]], rel=1e-6)
        u = xxh64_intdigest((17).to_bytes(4, "little"), xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)) >> 11
        assert x.selected == (n > 0 and u * 2.0**-53 < x.probability)


def test_topics_are_found(spark):
    """Three vocabularies in two languages, a third of the words being common ones: clusters are the vocabularies, whatever the language."""
    from collections import Counter

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    common = {la: [word() for _ in range(20)] for la in ("en", "de")}
    own = [[word() for _ in range(30)] for _ in range(3)]
    rows = []
    for k in range(600):
        la, t = r.choice(["en", "de"]), k % 3
        rows.append((k, " ".join(r.choice(common[la]) if r.random() < 0.33 else r.choice(own[t]) for _ in range(r.randint(60, 200))), la, "s"))
    rows += [(700, None, "en", "s"), (701, "a b", None, "s")]
    got = {x.doc.doc_id: x.mix_topic for x in mixing.mix(docs(spark, rows), n_topics=3).collect()}
    assert got[700] == got[701] == ""
    best = [Counter(got[k] for k in range(600) if k % 3 == t).most_common(1)[0] for t in range(3)]
    assert len({b[0] for b in best}) == 3 and sum(b[1] for b in best) >= 570
    again = {x.doc.doc_id: x.mix_topic for x in mixing.mix(docs(spark, rows).repartition(3), n_topics=3).collect()}
    assert again == got


def test_topics_and_limits(spark):
    d = docs(spark, [(1, "a bbb cc"), (2, "a bbb cc"), (3, "x")])
    got = {x.doc.doc_id: x.mix_topic for x in mixing.mix(d).collect()}
    assert got[1] == got[2]
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, [(1, "a", "en", "x"), (2, "b", "en", "y")]), max_cells=1)


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
