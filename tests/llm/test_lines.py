import random

import numpy as np
import pytest

from mapquarry.llm import line_dedup

from .helpers import docs


def shingles(line):
    """The 10 characters from every character on; a shorter line is one."""
    return {line[k : k + 10] for k in range(max(1, len(line) - 9))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def brute(rows):
    """Places (null id, id, row, place) removed, with all pairs of whole lines compared."""
    at = [((i is None, i or 0, k, pos), shingles(x)) for k, (i, t) in enumerate(rows) for pos, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
    parent = list(range(len(at)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(at)):
        for b in range(a):
            x, y = at[a][1], at[b][1]
            if find(a) != find(b) and jaccard(x, y) >= 0.8:
                parent[find(a)] = find(b)
    first = {}
    for k, (place, _) in enumerate(at):
        first[find(k)] = min(first.get(find(k), place), place)
    return {place for k, (place, _) in enumerate(at) if first[find(k)] != place}


def found(frame, **more):
    """The same from the operator; rows are counted in the order of their keys."""
    got = sorted(line_dedup.removed_lines(frame, **more).collect(), key=lambda r: r.row)
    return {(r.doc_id is None, r.doc_id or 0, k, p) for k, r in enumerate(got) for p in r.removed}


def make(seed, n=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    pool = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 12, 40, 60]))) for _ in range(30)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(pool).split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(vocabulary)
            lines.append(" ".join(w))
        rows.append((k, "\n".join(lines)))
    return [*rows, (None, pool[0]), (3, rows[3][1]), (500, None), (501, ""), (502, " \n\t\n"), (503, pool[1] + "\r\n" + pool[1])]


def test_against_all_pairs(spark):
    missed = total = 0
    for seed in (1, 2, 7):
        rows = make(seed)
        have, want = found(docs(spark, rows).coalesce(1)), brute(rows)
        assert have <= want
        total += len(want)
        missed += len(want - have)
    assert missed <= 0.02 * total and total > 150


def test_recall_of_single_pairs(spark):
    """Pairs of lines with 0.8 to 0.9 of their shingles in common, which nothing else links."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 9)))
    rows = []
    while len(rows) < 600:
        w = [word() for _ in range(r.choice([25, 40, 70]))]
        v = list(w)
        for _ in range(r.choice([1, 2, 3])):
            v[r.randrange(len(v))] = word()
        if 0.8 <= jaccard(shingles(" ".join(w)), shingles(" ".join(v))) < 0.9:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    have = found(docs(spark, rows).coalesce(1))
    assert {i % 2 for _, i, _, _ in have} == {1} and len(have) >= 0.97 * len(rows) / 2


@pytest.mark.parametrize(("window", "pivots"), [(8, 8), (1, 1)])
def test_large_bands(spark, window, pivots):
    """A hundred variants of one line, and lines that share half a line but are not similar, in bands beyond the window."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base, half = [word() for _ in range(60)], [word() for _ in range(30)]
    rows = []
    for k in range(100):
        w = list(base)
        w[r.randrange(60)] = f"new{k}"
        rows.append((k, " ".join(w)))
    for k in range(100, 300, 2):
        w = half + [word() for _ in range(14)]
        rows.append((k, " ".join(w)))
        w[r.randrange(44)] = word()
        rows.append((k + 1, " ".join(w)))
    have, want = found(docs(spark, rows).coalesce(1), window=window, pivots=pivots), brute(rows)
    assert have <= want and len(want) >= 190 and len(want - have) <= 0.05 * len(want)


def test_lines_are_compared_to_their_ends(spark):
    """Lines without spaces, and long words, that differ only after the first ten characters are kept."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    url = "https://example.com/" + word(60)
    long = [word(40) for _ in range(5)]
    texts = [
        "https://example.com/a/one\nhttps://example.org/b/other",
        "https://example.org/articles/one\nhttps://example.org/other/page-two\nhttps://examination.net/x",
        "supercalifragilistic\nsupercalifornication\n2024-01-15T10:00:00Z\n2024-01-15T23:59:59Z",
        "今天天气很好我们去公园散步吧\n今天天气很好我们去公司加班写报告",
        " ".join(w[:10] + word(30) for w in long) + "\n" + " ".join(long),
        "short\nshort x\n" + url + "\n" + url + "/\nshort\n   \n" + "\U0001f600" * 3 + url[:60],
        " ".join(long[:4]) + " " + long[4][:-1],
    ]
    rows = list(enumerate(texts))
    assert found(docs(spark, rows).coalesce(1)) == brute(rows) == {(False, 5, 5, 3), (False, 5, 5, 4), (False, 6, 6, 0)}


def test_hashes_of_shingles_wherever_they_stand(monkeypatch):
    """Equal shingles have equal hashes and others have not, for short lines and empty ones among long ones, in pieces of any size."""
    r = random.Random(12)
    lines = ["".join(r.choice("ab é中") for _ in range(r.choice([0, 1, 2, 9, 10, 11, 40]))) for _ in range(400)]
    h, count = line_dedup.shingle_hashes(lines)
    want = [x[k : k + 10] for x in lines for k in range(max(len(x) > 0, len(x) - 9))]
    assert count.sum() == len(want) == len(h) and len(set(want)) == len(set(h.tolist())) == len(set(zip(want, h.tolist(), strict=True)))
    some = [x for x in lines if x]
    whole = line_dedup.signatures(some)
    monkeypatch.setattr(line_dedup, "TOGETHER", 100)
    ranges = list(line_dedup.in_pieces(some, few=True))
    assert max(sum(map(len, some[a:z])) for a, z in ranges) <= 100
    assert np.array_equal(whole, np.concatenate([line_dedup.signatures(some[a:z]) for a, z in ranges]))


def test_very_long_lines(spark, monkeypatch):
    """Lines hashed piece by piece have the same signature and similarity."""
    r = random.Random(5)
    text = "".join(r.choice("abcdefghij klmnop") for _ in range(5000))
    other = text[:4000] + "x" * 40 + text[4000:]
    whole = line_dedup.signatures([text])
    monkeypatch.setattr(line_dedup, "PIECE", 256)
    assert np.array_equal(whole, line_dedup.signatures([text]))
    want = jaccard(shingles(text), shingles(other))
    for t in (want - 0.001, want + 0.001):
        assert line_dedup.similar([text], [other], t).tolist() == [want >= t]
    assert line_dedup.similar(["a", text, "ab"], ["a", text, "b"], 0.8).tolist() == [True, True, False]


def test_prefix_filter_finds_all_pairs(monkeypatch):
    """All similar pairs of different roots, for keys with few and with many lines."""
    import pyarrow as pa

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    common = [word() for _ in range(20)]
    lines = []
    for _ in range(40):
        w = common + [word() for _ in range(20)]
        for _ in range(3):
            lines.append(" ".join(w))
            w[20 + r.randrange(20)] = word()
    text = pa.RecordBatch.from_pydict({"text": ["\n".join(lines)], "want": [[{"id": k, "pos": k} for k in range(len(lines))]]})
    sets = pa.Table.from_batches(line_dedup._set_rows([text]))
    rows = sets.append_column("root", pa.array([k % 50 for k in range(len(lines))])).combine_chunks().to_batches()[0]
    for threshold in (0.6, 0.8):
        want = {(a, b) for b in range(len(lines)) for a in range(b) if a % 50 != b % 50 and jaccard(shingles(lines[a]), shingles(lines[b])) >= threshold}
        for counts in (np.zeros(line_dedup.BUCKETS, np.int64), None):
            if counts is None:
                counts = np.zeros(line_dedup.BUCKETS, np.int64)
                for c in line_dedup._count_rows([rows]):
                    counts[c.column("bucket").to_numpy()] = c.column("n").to_numpy()
                assert counts.sum() == sum(len(shingles(x)) for x in lines)
            keyed = pa.Table.from_batches(line_dedup._prefix_rows(counts, threshold)([rows])).sort_by("key")
            for small in (2, 32):
                got = set()
                for out in line_dedup._cross_rows(threshold, small=small)(keyed.to_batches(max_chunksize=37)):
                    got |= set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
                assert want <= got and len(want) > 30


def test_prefix_filter_passes_few_other_pairs(monkeypatch):
    """Of variants of a line that share much and are not similar hardly a pair is left to be compared; very long lines always are."""
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "PIECE", 2000)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base, lines = [word() for _ in range(40)], []
    for _ in range(60):
        w = list(base)
        for k in r.sample(range(40), 2):
            w[k] = word()
        lines.append(" ".join(w))
    long = " ".join(word() for _ in range(400))
    lines += [lines[7] + " x", long, long + " y"]
    pairs = {(a, b): jaccard(shingles(lines[a]), shingles(lines[b])) for b in range(len(lines)) for a in range(b)}
    text = pa.RecordBatch.from_pydict({"text": ["\n".join(lines)], "want": [[{"id": k, "pos": k} for k in range(len(lines))]]})
    sets = pa.Table.from_batches(line_dedup._set_rows([text]))
    assert sets.column("n").to_pylist() == [len(shingles(x)) if len(x) <= 2000 else None for x in lines]
    rows = sets.append_column("root", pa.array(range(len(lines)))).combine_chunks().to_batches()[0]
    keyed = pa.Table.from_batches(line_dedup._prefix_rows(np.zeros(line_dedup.BUCKETS, np.int64), 0.8)([rows])).sort_by("key")
    for small in (2, 32):
        got = set()
        for out in line_dedup._cross_rows(0.8, small=small)(keyed.to_batches(max_chunksize=501)):
            got |= set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
        want = {p for p, s in pairs.items() if s >= 0.8}
        assert {(7, 60), (61, 62)} <= want <= got
        assert len(got - want) <= 0.05 * sum(0.5 <= s < 0.8 for s in pairs.values())


def test_text_and_empty_table(spark):
    d = docs(spark, [(1, "first line of it\nother words here\nfirst line of it"), (2, "other words here\nnew one"), (3, None)])
    out = {r.doc_id: r.text for r in line_dedup.dedup(d).collect()}
    assert out == {1: "first line of it\nother words here", 2: "new one", 3: None}
    assert line_dedup.removed_lines(docs(spark, [])).count() == 0
