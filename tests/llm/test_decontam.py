import random

from mapquarry.llm import decontam

from .helpers import docs, order


def levenshtein_inside(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        row = [i]
        for j, d in enumerate(t, 1):
            row.append(min(prev[j - 1] + (c != d), prev[j] + 1, row[-1] + 1))
        prev = row
    return min(prev)


def test_myers():
    r = random.Random(1)
    for _ in range(300):
        p = "".join(r.choice("ab c") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("ab c") for _ in range(r.randint(0, 120)))
        assert decontam.best_distance(p, t)[0] == levenshtein_inside(p, t)


def words(r, n):
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_against_brute_force(spark):
    r = random.Random(2)
    items = [(k, words(r, r.randint(3, 45))) for k in range(25)] + [(50, "!!"), (51, None), (52, "hi you")]
    rows = []
    for k in range(120):
        t = words(r, r.randint(0, 80))
        if r.random() < 0.6:
            p = list(r.choice(items[:25])[1])
            for _ in range(int(len(p) * r.choice([0, 0.03, 0.07, 0.1, 0.2]))):
                at = r.randrange(len(p))
                p[at : at + 1] = r.choice(["", "x", "qz"])
            t = f"{t} {''.join(p).upper()}, {words(r, 5)}"
        rows.append((k, t))
    rows += [(900, None), (901, ""), (902, "say hi, you!"), (903, "chi you"), (None, items[3][1]), (2**60 + 1, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.distance) for x in decontam.contamination(docs(spark, rows), bench).collect()]
    want = []
    for i, t in rows:
        nt = decontam.normal(t)
        for j, it in items:
            p = decontam.normal(it)
            if not p:
                continue
            k = decontam.budget(len(p), 0.08, 40)
            d = levenshtein_inside(p, f" {nt} ") if len(p) >= 40 else 0 if f" {p} " in f" {nt} " else 1
            if nt and d <= k:
                want.append((i, j, d))
    assert order(got) == order(want)
    clean = decontam.decontaminate(docs(spark, rows), bench)
    assert clean.columns == docs(spark, []).columns
    hit = {w[0] for w in want}
    assert order((x.doc_id,) for x in clean.collect()) == order((i,) for i, _ in rows if i not in hit)


def test_blocks_and_empty_tables(spark):
    bench = spark.createDataFrame([(k, f"some item number {k} with a good length of text") for k in range(5)], "item_id long, text string")
    assert [len(b) for b in decontam.blocks(bench, max_chars=100)] == [2, 2, 1]
    assert decontam.contamination(docs(spark, []), bench).count() == 0
    d = docs(spark, [(1, "x")])
    assert decontam.contamination(d, bench.where("false")).count() == 0 and decontam.decontaminate(d, bench.where("false")).count() == 1
