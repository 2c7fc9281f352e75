"""What several operators share: word patterns, native bindings, shared scratch, checked broadcasts, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bladewatch.session import scratch_path, shared_root, ship

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000  # narrow rows; a table with more of them is joined by shuffling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows as files in the shared checkpoint folder, with the lineage cut."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))  # fails on a cluster without a shared folder
    return df.checkpoint()


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: as ``stored``, but compressed and read by column."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table for broadcast if a count finds it small enough; else it is joined as any other."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def own_row(docs: DataFrame, name: str) -> Column:
    """All columns of a row as one struct, so that none clashes with those an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)


def words_of(text: Column) -> Column:
    """All words of the text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component), the component named by its smallest node.

    Alternates large-star and small-star steps, each a join of the edges with the smallest neighbour of one end,
    until the edge set stays as it is. Nodes without an edge to another node are not returned. Copies and loops
    in the list do no harm; a node with very many edges is split by the adaptive join.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = stored(small)
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
