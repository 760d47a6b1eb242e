import re
from collections import Counter

import pytest

from mapquarry.llm import quality

from .helpers import docs, order

GOOD = "The quick brown fox is jumping over the lazy dog and this text of many words was written for a test. " * 1
WORDS = "alpha beta gamma delta of the and to in is that it for was on with as be at by this from or an are not".split()


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    hit = set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            hit |= {k, k + 1, k + 2}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


TEXTS = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n\n x", "p\x0bq\x0cr\x1cs t", "a|b #c **d** <e>", "é ü 😀 é ü 😀 é ü", "a\r\nb\r\na\r\n",
    " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k % 7}" for k in range(300)), "b a " * 9000, " ".join(f"v{k % 4000}" for k in range(20000)), "a\n" * 5000,
]


def test_counts_against_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a b c"), (3, "one")]
    got = quality.quality(docs(spark, rows), ["doc_id"]).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert order(got) == order((i, *base(t)) for i, t in rows)


def test_counts_where_shortened_hashes_clash(spark):
    """With hardly any bits of the hash left, all texts go the way of whole hashes."""
    rows = list(enumerate(TEXTS))
    for bits in (60, 5):
        got = quality.features(docs(spark, rows), ["doc_id"], place_bits=bits).select("doc.doc_id", "n_words", "n_repeat_words").collect()
        assert order(got) == order((i, base(t)[0], base(t)[4]) for i, t in rows)


def test_counts_of_a_very_long_text(spark):
    """2^21 words; three of four windows stand twice."""
    n = 1 << 19
    text = " ".join([f"a{k}" for k in range(n)] + [f"b{k}" for k in range(3 * n // 4)] * 2)
    got = quality.features(docs(spark, [(1, text)]), ["doc_id"]).select("n_words", "n_repeat_words").first()
    assert tuple(got) == (n + 3 * n // 2, 3 * n // 2)


def test_rejects_junk_and_keeps_prose(spark):
    import random

    r = random.Random(2)
    prose = [(k, ". ".join(" ".join(r.choice(WORDS) + r.choice(["", "ly", "er", "ing"]) * (r.random() < 0.4) for _ in range(12)) for _ in range(9))) for k in range(200)]
    junk = [(1000 + k, " ".join(r.choice(["QQ", "ZZX", "KLM", "RTX"]) + str(r.randint(0, 9999)) + r.choice("#%&|$") for _ in range(90))) for k in range(30)]
    got = {x.doc.doc_id: x.kept for x in quality.quality(docs(spark, prose + junk), ["doc_id"]).collect()}
    assert sum(got[k] for k, _ in prose) >= 198 and not any(got[k] for k, _ in junk)


def test_estimate_finds_accuracies():
    import random

    r = random.Random(1)
    truth = [(0.95, 0.6), (0.9, 0.7), (0.97, 0.5), (0.92, 0.8)]
    seen: Counter = Counter()
    for _ in range(20_000):
        good = r.random() < 0.85
        seen[tuple(0 if r.random() < 0.2 else (1 if (r.random() < a) == good or (not good and r.random() >= b and False) else -1) if good else (-1 if r.random() < b else 1) for a, b in truth)] += 1
    prior, acc = quality.estimate(sorted(seen.items()))
    assert prior == pytest.approx(0.85, abs=0.03)
    assert all(x == pytest.approx(t, abs=0.06) for got, want in zip(acc, truth) for x, t in zip(got, want))


def test_empty_table(spark):
    assert quality.quality(docs(spark, []), ["doc_id"]).count() == 0
