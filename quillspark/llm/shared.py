"""What several operators share: columns by any name, ids of any type, hashes, and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.durable import cut, dropped, shared_dir
from quillspark.operators.skew import attached

__all__ = ["attached", "column", "components", "cut", "dropped", "extended", "fresh", "numbered", "original", "selected", "shared_dir", "slots"]


def quoted(name: str) -> str:
    """A column's name as Spark reads it back, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    """The column of ``df`` with exactly this name."""
    return df[quoted(name)]


def selected(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns of ``df``, under new names: whatever else it has, however it is called, can't clash."""
    return df.select(*[column(df, old).alias(new) for new, old in columns.items()])


def extended(df: DataFrame, run, added: Sequence[T.StructField]) -> DataFrame:  # type: ignore[no-untyped-def]
    """``df.mapInArrow(run)`` for columns of any name: ``run`` sees them as c0, c1, ... and yields them with the columns ``added``."""
    fields = [T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(df.schema.fields)]
    plain = df.toDF(*[f.name for f in fields])
    return plain.mapInArrow(run, T.StructType([*fields, *added])).toDF(*df.columns, *[f.name for f in added])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with its id column as bigint, and what the numbers stand for (``number``, ``value``; None if the ids are whole numbers).

    Ids of another type, such as strings, are replaced by numbers in the order of the ids: distinct ids are sorted by range, and
    each partition's numbers follow those of the one before. Null ids stay null. That is one shuffle of the distinct ids and one join.
    """
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return df.withColumn(name, F.col(name).cast("bigint")), None
    if isinstance(df.schema[name].dataType, T.NullType):
        return df.withColumn(name, F.lit(None).cast("bigint")), None
    ids = df.select(F.col(name).alias("value")).where("value is not null").distinct()
    ids = cut(ids.repartitionByRange("value").sortWithinPartitions("value").select(F.monotonically_increasing_id().alias("number"), "value"))
    rest = [c for c in df.columns if c != name]
    return df.join(ids, df[name] == ids["value"], "left").select(F.col("number").alias(name), *rest).select(*df.columns), ids


def original(df: DataFrame, ids: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """``df`` with the numbers of ``numbered`` in the given columns turned back."""
    if ids is None:
        return df
    for c in columns:
        back = ids.select(F.col("number").alias("__number"), F.col("value").alias("__value"))
        df = df.join(back, df[c] == back["__number"], "left").select(*[F.col("__value").alias(c) if x == c else df[x] for x in df.columns])
    return df


def slots(*columns: Column | str) -> Column:
    """A well mixed non-negative 63-bit number of the columns."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def _with_least(pairs: DataFrame, n: int, hot: int) -> DataFrame:
    """``pairs`` (k, x), ``n`` of them, with m, the least x of each k.

    One shuffle by k; no row ever holds the neighbours of a key. Keys with more than ``hot`` pairs, of which there are n / hot at most, meet their minima (which are summed up before
    their shuffle) by a broadcast instead.
    """
    least = F.min("x").over(Window.partitionBy("k"))
    if n <= hot:
        return pairs.withColumn("m", least)
    top = pairs.groupBy("k").agg(F.min("x").alias("m"), F.count("*").alias("n")).where(F.col("n") > hot).select("k", "m")
    hubs = pairs.sparkSession.createDataFrame(top.collect(), top.schema)
    marked = pairs.join(F.broadcast(hubs), "k", "left")
    return marked.where("m is null").drop("m").withColumn("m", least).unionByName(marked.where("m is not null"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, hot: int = 1_000_000) -> DataFrame:
    """(``node``, ``root``) of every node of ``edges``; the root is the smallest node that a path leads to.

    Alternates the large-star and small-star steps: each gives every edge the minimum of its node's neighbours. A node with more than
    ``hot`` edges (or a ten-thousandth of all, if that is more: so there are 20,000 of them at most) gets it by a broadcast. Every round is cut, so the
    plan stays short and a lost executor repeats one round at most. Self-loops, repeated edges and null ends are allowed.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = cut(e)

    def state() -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state()
    for _ in range(rounds):
        most = max(hot, 2 * now[0] // 10_000)
        # large star: every neighbour above a node goes to the smallest of the node and its neighbours
        both = e.select(F.col("u").alias("k"), F.col("v").alias("x")).union(e.select(F.col("v").alias("k"), F.col("u").alias("x")))
        large = _with_least(both, 2 * now[0], most).where("x > k").select(F.col("x").alias("k"), F.least("k", "m").alias("x")).distinct()
        # small star: a node and its neighbours below it go to the smallest of them
        low = _with_least(large, now[0], most)
        small = low.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("k").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = cut(small)
        before, now = now, state()
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
