"""Shared helpers: reading tables, reliable checkpoints, row keys, numpy union-find."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import storage

#: White space that ends a word: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a temporary folder where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = storage.checkpoint_dir(spark)
    return f"{base.rstrip('/')}/mapquarry-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: columns can be pruned later. It goes when the application ends."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Plan nodes whose rows stand in the same partition and order whenever they are computed again.
_STEADY = frozenset("Project Filter LogicalRelation LogicalRDD LocalRelation Range SubqueryAlias".split())


def _steady(df: DataFrame) -> bool:
    open_ = [df._jdf.queryExecution().optimizedPlan()]
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() not in _STEADY:
            return False
        below = node.children()
        open_ += [below.apply(k) for k in range(below.size())]
    return True


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Number the rows, so that repeated and null ids stay separate rows.

    The number is fixed by file split and place in it, hence the same when a lost task or a second
    branch of the plan reads the input again. An input that comes from more than a scan with
    projections and filters is written to the shared folder first.
    """
    return (df if _steady(df) else written(df)).withColumn(name, F.monotonically_increasing_id())


def packed_rows(docs: DataFrame, columns: list[str] | None = None, **more: Column) -> DataFrame:
    """The columns (all by default) in one struct doc, so that no name of the user's clashes with an operator's own, and more columns beside it."""
    return docs.select(F.struct(*[_column(docs, c) for c in columns or docs.columns]).alias("doc"), *[v.alias(k) for k, v in more.items()])


def _column(docs: DataFrame, name: str) -> Column:
    return docs["`" + name.replace("`", "``") + "`"]


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of doc again, those named in new replaced."""
    return df.select(*[new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in columns])


def sample_texts(rows: DataFrame, key: str, n: int) -> list[str]:
    """About n whole texts, evenly over all rows by the hash of a unique key; for fitting only.

    The expected size is n (2 n where there are few rows) whatever the input, and only the sample
    itself leaves the tasks."""
    every = max(1, rows.count() // max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(every)) == 0)
    return [r[1] for r in sorted(picked.select(key, F.coalesce("text", F.lit(""))).collect())]


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for edges a-b among nodes 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        label = new[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label
