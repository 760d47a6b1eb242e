import zlib

import numpy as np
import pytest

from mapquarry.llm import token_shards

from .helpers import docs

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "\n\n", "Hello, world! It's 3 o'clock.", "a  b\t\tc\n", "  lead", "trail  ", "naïve café — 東京 😀", "x y　z", "a\x0bb", "<|endoftext|> in text", "don't, can't; we'll", "A" * 5000, "word " * 3000, "Á,b.c;d", "tab\t,x", "\r\nq"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()


def test_encoder_is_the_library(tokenizer):
    import random

    r = random.Random(6)
    texts = TEXTS + ["".join(r.choice("ab'sté ²3 \n\t\r ,.!?|#<>- 中😀") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join("\n" * (r.random() < 0.2) + r.choice(["and", "the", "It's", "end.", "(x)", "—", "東京", "\0", "42", "a-b", "é,"]) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    e = token_shards.Encoder(PATH, 2, max_words=500)
    assert [x for x in e(texts)] == [want(tokenizer, t) for t in texts]


@pytest.mark.parametrize("texts", [["\0"], ["\0 a  b"], ["hello", "\0hello", "\0hello"], ["a b", "\0a  b", "", "\0"]])
def test_texts_that_begin_with_a_zero_character(tokenizer, texts):
    assert list(token_shards.Encoder(PATH, 2)(texts)) == [want(tokenizer, t) for t in texts]


def test_uneven_texts():
    """The plain searches find what one pattern of alternatives would."""
    import random
    import re

    r, pattern = random.Random(9), re.compile("[ \n][ \n]|[\t\r\0]|[\\W_][,.;:!?]|" + token_shards._WHOLE.pattern)
    texts = ["".join(r.choice("abcé_² 3\n\t\0,.!?|<- 中😀\x0b\u3000") for _ in range(r.randint(0, 6))) for _ in range(20000)]
    have = [token_shards._uneven(t) for t in texts]
    assert have == [bool(pattern.search(t)) for t in texts] and 1000 < sum(have) < 19000


def test_round_trip(spark, tokenizer):
    rows = [(100 - k, t) for k, t in enumerate(TEXTS)] + [(3, None), (3, "again"), (3, "again"), (None, "no id"), (-(2**63), "least"), (2**63 - 1, "most")]
    got = sorted(token_shards.round_trip(docs(spark, rows), PATH).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1] == -(2**63) and ids[1:] == sorted(ids[1:]) and len(ids) == len(rows)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert have == sorted((-1 if i is None else i, len(w) // 4, zlib.crc32(w)) for i, t in rows for w in [want(tokenizer, t)])


def test_one_document_by_itself(spark, tokenizer, tmp_path):
    rows = [(k, f"some text number {k} of the shard " * 5) for k in range(50)]
    shards = token_shards.write(docs(spark, rows), str(tmp_path), PATH, partitions=2)
    fs, root = token_shards._fs(str(tmp_path))
    dictionary = fs.open_input_stream(f"{root}/dictionary.zdict").read()
    s = token_shards.Shard(fs, shards[-1][0], dictionary)
    k = s.n - 1
    assert s.ids[k] == 49 and s.raw(k) == want(tokenizer, rows[49][1])
    with pytest.raises(ValueError):
        token_shards.Shard(fs, shards[-1][0], b"another")
    assert not [p for p in tmp_path.iterdir() if "tmp" in p.name or "body" in p.name]


def test_empty_table(spark):
    assert token_shards.round_trip(docs(spark, []), PATH).count() == 0
