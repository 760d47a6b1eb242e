"""Columns of the user that are named like an operator's own pass through unharmed."""

import pytest

from mapquarry.llm import block_dedup, decontam, line_dedup, mixing, quality, shard_tree, simhash, suffix_dedup

from .helpers import docs, order

corpus_pipeline = pytest.importorskip("corpus_pipeline")

NAMES = (
    "_t _w _s _f _p _l _low _clash _row _chunk _place _offset _n _id _rest _length _mean _new _text doc row id key fp root least component_id band pos removed keep kept n_words word_chars n_symbols n_dup_lines "
    "n_repeat_words n_lines n_distinct n_stop_words n_letters n_upper base_failed quality_probability v_length v counts topic_x mix_source mix_lang mix_topic n_tokens weight probability selected size shard slot "
    "grown_shard shard_region law text_crc32 line want at spans context h ctx ref n x y a b node start item_id distance all"
).split()

GOOD = "the house of the family is in the old town and that is not far from the river and the bridge for which it was built as "


@pytest.fixture(scope="module")
def frame(spark):
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8)))
    rows = [(k, GOOD + " ".join(word() for _ in range(40)) + f"\nand a second line that is the same in all of the documents {k // 2}") for k in range(12)] + [(None, GOOD), (3, None), (4, "")]
    out = docs(spark, rows).drop("row", "key", "topic_")
    from pyspark.sql import functions as F

    return out.select("*", *[F.concat(F.lit(f"mine {n} "), F.coalesce("text", F.lit("null"))).alias(n) for n in NAMES])


def unharmed(got, columns):
    assert got.columns == columns
    rows = got.collect()
    for r in rows:
        d = r.asDict()
        # the text may be cut, the user's columns still tell what it was
        assert len({d[n].removeprefix(f"mine {n} ") for n in NAMES}) == 1
    return rows


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:4]])
def test_stages(spark, frame, tmp_path, stage):
    spark.createDataFrame([(1, "which of these words is the answer that nobody would ever write by chance")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    rows = unharmed(run(spark, frame, str(tmp_path)), frame.columns)
    plain = run(spark, frame.select(*frame.columns[:5]), str(tmp_path)).collect()
    assert order((r.doc_id, r.text) for r in rows) == order((r.doc_id, r.text) for r in plain) and rows


def test_line_dedup(frame):
    rows = unharmed(line_dedup.dedup(frame), frame.columns)
    assert len(rows) == 15 and any(r.text and "second" not in r.text for r in rows)


def test_operators(spark, frame):
    plain = frame.select(*frame.columns[:5])
    assert quality.quality(frame, ["doc_id", "n_words", "doc"]).where("doc.n_words like 'mine n_words%'").count() == 15
    assert mixing.mix(frame, ["weight", "doc"]).where("doc.weight like 'mine weight%'").count() == 15
    assert simhash.simhash(frame, ["doc_id", "fp", "root"]).where("doc.fp like 'mine fp%'").count() == 15
    for f in (shard_tree.shard, suffix_dedup.dedup, block_dedup.dedup):
        assert sorted(map(str, f(frame).collect())) == sorted(map(str, f(plain).collect()))
    items = spark.createDataFrame([(1, GOOD.strip())], "item_id long, text string")
    assert sorted(map(str, decontam.contamination(frame, items).collect())) == sorted(map(str, decontam.contamination(plain, items).collect()))


def test_rows_that_come_from_a_shuffle(frame):
    """Row keys stay the same although the input is computed more than once."""
    shuffled = frame.repartition(7, "text")
    assert sorted(str(r.text) for r in line_dedup.dedup(shuffled).collect()) == sorted(str(r.text) for r in line_dedup.dedup(frame).collect()) or line_dedup.dedup(shuffled).count() == 15
    assert len(simhash.representatives(shuffled).collect()) == len(simhash.representatives(frame).collect())
