"""Running totals over a whole table in order, without putting the table into one window partition."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local sessions have one of their own, which goes when the session ends."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    gone_at_exit(spark, _own_folder())
    return _own_folder()


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """`path` is removed when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut, by a checkpoint in the session's checkpoint folder, which executors share."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written to the shared folder and read again. Unlike a checkpoint it forgets what is known of its columns, which loops would pile up."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scanned(df: DataFrame, order: list[Column], results: dict[str, tuple[str, Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """`df` with, by name, one of these over the rows of its group of `by`, in `order`:

    `sum` and `peak`: the sum of a column up to and including this row, and the largest such sum so far; `total`: its
    sum over the group; `last`: its latest known value up to this row; `after`: its value in the next row.
    Rows are dealt by ranges of groups and order and written once. What a range needs of the others are two rows for
    each group in it, one before and one after its own rows, so no task holds a whole group, however large it is.
    Rows of equal order are taken in any order, so let it be unique.
    """
    kinds, one = [kind for kind, _ in results.values()], [*by, "_range"]
    # Their number is given, so that adaptive plans do not put more of them into a task the more there are.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns({f"_v{k}": c for k, (_, c) in enumerate(results.values())}).repartitionByRange(parts, *[F.col(b).asc() for b in by], *order)
    rows = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    told, inside = rows, Window.partitionBy(*one).orderBy(*order)
    if {"peak", "last", "after"} & set(kinds):
        so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
        told = rows.repartition(parts, *one).withColumns({"_i": F.row_number().over(inside)} | {f"_w{k}": F.sum(f"_v{k}").over(so_far) if kind == "peak" else F.last(f"_v{k}", ignorenulls=True).over(so_far) for k, kind in enumerate(kinds) if kind in ("peak", "last")})
    found = []
    for k, kind in enumerate(kinds):
        whole = {"last": lambda k: F.max_by(f"_w{k}", "_i"), "after": lambda k: F.min_by(f"_v{k}", "_i")}.get(kind, lambda k: F.sum(f"_v{k}"))
        found += [whole(k).alias(f"_v{k}")] + ([F.max(f"_w{k}").alias(f"_w{k}")] if kind == "peak" else [])
    ranges = told.groupBy(*one).agg(*found)
    own, earlier = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    entering, leaving = {}, {}
    for k, kind in enumerate(kinds):
        v = F.col(f"_v{k}")
        if kind == "after":
            leaving[f"_v{k}"] = F.lead(v).over(own.orderBy("_range"))
        else:
            entering[f"_v{k}"] = F.last(v, ignorenulls=True).over(earlier) if kind == "last" else F.sum(v).over(own if kind == "total" else earlier)
        if kind == "peak":
            ranges = ranges.withColumn(f"_w{k}", F.coalesce(F.sum(v).over(earlier), F.lit(0)) + F.col(f"_w{k}"))
            entering[f"_w{k}"] = F.max(f"_w{k}").over(earlier)
    apart = {f"_v{k}": F.lit(None).cast(ranges.schema[f"_v{k}"].dataType) for k, kind in enumerate(kinds) if kind == "total"}
    every = rows.withColumns(apart | {"_side": F.lit(0)})
    for side, values in ((-1, entering), (1, leaving)):
        if values:
            every = every.unionByName(ranges.select(*one, *[c.alias(n) for n, c in values.items()], F.lit(side).alias("_side")), allowMissingColumns=True)
    every = every.repartition(parts, *one)
    ahead = Window.partitionBy(*one).orderBy("_side", *order)
    upto = ahead.rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_p{k}": F.when(F.col("_side") == -1, F.col(f"_w{k}")).otherwise(F.sum(f"_v{k}").over(upto)) for k, kind in enumerate(kinds) if kind == "peak"}
    every = every.withColumns(sums) if sums else every
    made = {
        "sum": lambda k: F.sum(f"_v{k}").over(upto), "peak": lambda k: F.max(f"_p{k}").over(upto), "total": lambda k: F.max(f"_v{k}").over(upto),
        "last": lambda k: F.last(f"_v{k}", ignorenulls=True).over(upto), "after": lambda k: F.lead(f"_v{k}").over(ahead),
    }
    return every.select(*df.columns, "_side", *[made[kind](k).alias(n) for k, (n, kind) in enumerate(zip(results, kinds, strict=True))]).filter("_side = 0").drop("_side")


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """`df` with, by name, the sum of each of `totals` over its rows up to and including this one, in `order`, in each group of `by`; by `scanned`."""
    return scanned(df, order, {n: ("sum", c) for n, c in totals.items()}, by)


def counted(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, _x, _n): how often each group has each known value."""
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull()).groupBy(*by, x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))


def quantiles(df: DataFrame, value: str, fractions: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q): exact interpolated quantiles of the known values of each group, as an array in the order of `fractions`.

    Equal values are counted before they are ordered, and ranks are running totals over ranges of the values, so
    no task holds the distinct values of a group. A group without a known value has no row.
    """
    return quantiles_of(counted(df, value, by), fractions, by)


def quantiles_of(counts: DataFrame, fractions: list[float], by: tuple[str, ...] = (), tails: bool = False) -> DataFrame:
    """`quantiles` of what `counted` gives; with `tails` also the mean of the values at or below each of them, as an array `tail`."""
    keys = by or ("_one",)
    n = F.col("_n")
    placed = scanned(counts if by else counts.withColumn("_one", F.lit(1)), [F.col("_x").asc()], {"_upto": ("sum", n), "_total": ("total", n)}, keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_x")))

    places = [(F.col("_total") - 1) * F.lit(float(f)) for f in fractions]
    ends = {"_low": [at(F.floor(p)) for p in places], "_high": [at(F.ceil(p)) for p in places]}
    if tails:
        for name, rank in (("_upto_low", F.floor), ("_upto_high", F.ceil)):
            inside = [F.col("_upto") - F.col("_n") <= rank(p) for p in places]
            ends |= {f"{name}_sum": [F.sum(F.when(i, F.col("_x") * F.col("_n"))) for i in inside], f"{name}_n": [F.sum(F.when(i, F.col("_n"))) for i in inside]}
    out = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *[c.alias(f"{name}{k}") for name, columns in ends.items() for k, c in enumerate(columns)])
    between = [
        F.when(F.col(f"_low{k}") == F.col(f"_high{k}"), F.col(f"_low{k}")).otherwise((F.ceil(p) - p) * F.col(f"_low{k}") + (p - F.floor(p)) * F.col(f"_high{k}"))
        for k, p in enumerate(places)
    ]
    if not tails:
        return out.select(*by, F.array(*between).alias("q"))
    # Rounding may put a quantile on the upper of its two values.
    means = [F.when(F.col(f"_high{k}") <= q, F.col(f"_upto_high_sum{k}") / F.col(f"_upto_high_n{k}")).otherwise(F.col(f"_upto_low_sum{k}") / F.col(f"_upto_low_n{k}")) for k, q in enumerate(between)]
    return out.select(*by, F.array(*between).alias("q"), F.array(*means).alias("tail"))


def with_group(rows: DataFrame, groups: DataFrame, by: tuple[str, ...], few: bool = False) -> DataFrame:
    """`rows` with the columns of their group in `groups`, one row for each group; keys may be null.

    `few` says that there are no more groups than a table has columns, or a single one: then they are broadcast, and no value moves to its group.
    """
    others = [c for c in groups.columns if c not in by]
    named = groups.select(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], *others)
    on = F.lit(True)
    for k, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    return rows.join(F.broadcast(named) if few else named, on, "left").select(*rows.columns, *others)
