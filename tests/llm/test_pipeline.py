import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from mapquarry.llm import decontam, quality, shard_tree, simhash  # noqa: E402


def write(spark, folder, n=120):
    import random

    r = random.Random(8)
    vocabulary = "the of and to in is that it for was on with".split() + ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9))) for _ in range(500)]
    prose = lambda: ". ".join(" ".join(r.choice(vocabulary) for _ in range(11)) for _ in range(r.randint(7, 20)))
    item = "which of these words is the answer that nobody would ever write by chance in a text"
    rows = [(k, prose(), r.choice(["en", "de"]), r.choice(["a", "b"])) for k in range(n)]
    rows += [(1000 + k, rows[k][1], *rows[k][2:]) for k in range(10)]
    rows += [(2000, f"{rows[0][1][:300]} {item.upper()} {prose()}", "en", "a"), (2001, "x# " * 200, "en", "a"), (2002, None, "en", None), (2003, "", None, "b"), (None, prose(), "en", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = write(spark, str(tmp_path))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixture", "sharding"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == columns
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i))
    assert not {2001, 2002, 2003} & set(kept["quality_rules"]) and len(kept["quality_rules"]) >= 125
    assert not set(range(1000, 1010)) & set(kept["near_duplicates"]) and set(range(10)) <= set(kept["near_duplicates"])
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {2000}
    assert set(kept["mixture"]) <= set(kept["decontamination"]) and kept["sharding"] == kept["mixture"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_each_stage_by_itself(spark, tmp_path):
    """Every stage takes what the operator says, on its own input."""
    rows, item = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    assert ids(stage["quality_rules"](spark, docs, str(tmp_path))) == ids(quality.quality(docs, ["doc_id"]).where("kept").select("doc.doc_id"))
    assert ids(stage["near_duplicates"](spark, docs, str(tmp_path))) == ids(simhash.representatives(docs))
    m = decontam.Matcher([(1, decontam.normal(item))], 0.08, 40)
    assert ids(stage["decontamination"](spark, docs, str(tmp_path))) == sorted(str(r[0]) for r in rows if not m.find(r[1]))
    assert ids(stage["sharding"](spark, docs, str(tmp_path))) == ids(shard_tree.shard(docs))


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path), 10)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
