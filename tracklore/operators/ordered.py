"""Order-sensitive building blocks that stay parallel when one key is hot.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  The
functions here cut a key into ordered chunks, run the window inside a chunk and
carry one summary row per chunk forward, so that a key holding a third of the
table is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions.vectors import let
from tracklore.session import cut

_LOCAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe equi join that keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, "left").drop(*[f"__r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    specs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Running aggregates per key, up to and including the current row.

    ``chunk`` must not decrease along ``order`` within a key.  ``specs`` maps an
    output column to (kind, value), kind in sum, count, min, max, last (the last
    non-null value so far).
    """
    group = [*keys, "__chunk"]
    src = df.withColumn("__chunk", chunk)
    for name, (_, value) in specs.items():
        src = src.withColumn(f"__v_{name}", value)

    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    local, totals, carries = [], [], []
    for name, (kind, _) in specs.items():
        v = F.col(f"__v_{name}")
        if kind == "last":
            local.append(F.last(v, ignorenulls=True).over(inside).alias(f"__l_{name}"))
            totals.append(
                F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__t_{name}")
            )
            carries.append(
                F.last(f"__t_{name}", ignorenulls=True).over(before).alias(f"__c_{name}")
            )
        else:
            fn = _LOCAL[kind]
            local.append(fn(v).over(inside).alias(f"__l_{name}"))
            totals.append(fn(v).alias(f"__t_{name}"))
            again = F.sum if kind in ("sum", "count") else fn
            carries.append(again(f"__t_{name}").over(before).alias(f"__c_{name}"))

    carry = src.groupBy(*group).agg(*totals).select(*group, *carries)
    out = _join_on(src.select("*", *local), carry, group)
    for name, (kind, _) in specs.items():
        here, prior = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "last":
            value = F.coalesce(here, prior)
        elif kind in ("sum", "count"):
            value = F.when(here.isNull() & prior.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
            )
        elif kind == "min":
            value = F.least(here, prior)
        else:
            value = F.greatest(here, prior)
        out = out.withColumn(name, value)
    drop = ["__chunk"]
    for name in specs:
        drop += [f"__v_{name}", f"__l_{name}", f"__c_{name}"]
    return out.drop(*drop)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    cols: Mapping[str, Column],
) -> DataFrame:
    """Values of the row before, per key, chunked like :func:`running`."""
    group = [*keys, "__chunk"]
    packed = F.struct(*[v.alias(n) for n, v in cols.items()])
    src = df.withColumn("__chunk", chunk).withColumn("__p", packed)
    inside = Window.partitionBy(*group).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__chunk")
    carry = (
        src.groupBy(*group)
        .agg(F.max_by("__p", F.struct(*order)).alias("__last"))
        .select(*group, F.lag("__last").over(before).alias("__carry"))
    )
    out = _join_on(
        src.withColumn("__lag", F.lag("__p").over(inside)), carry, group
    )
    pick = F.coalesce(F.col("__lag"), F.col("__carry"))
    for n in cols:
        out = out.withColumn(n, pick[n])
    return out.drop("__chunk", "__p", "__lag", "__carry")


def _range_bucket(df: DataFrame, code: Column, parts: int | None) -> DataFrame:
    """Attach ``__b``: the range bucket of ``code``, bounds from one sketch row.

    There are as many ranges as the session has shuffle partitions, unless ``parts`` says otherwise.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / parts for i in range(1, parts)]
    bounds = df.agg(
        F.percentile_approx(code, probs, parts * 20).alias("b")
    ).select(F.array_distinct("b")).scalar()
    # the array holds at most `parts` numbers
    bucket = let(code, lambda c: F.size(F.filter("__bounds", lambda b: b < c)))
    return df.withColumn("__bounds", bounds).withColumn("__b", bucket).drop("__bounds")


def positions(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """1-based global row number without a single-task window.

    Rows are dealt by ranges of the order columns themselves and written once, so that the ranges are drawn from
    one sample; counts per range give each range its offset, and a window numbers rows inside a range. The order
    should tell rows apart: equal rows share a range.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()))
    sizes = placed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # one row per range: a one-partition window over them is bounded by the partition count
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__b", F.coalesce(before, F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__b").orderBy(*order)
    return (
        placed.withColumn("__rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__b")
        .withColumn(name, (F.col("__rn") + F.col("__off")).cast("bigint"))
        .drop("__b", "__rn", "__off")
    )


def competition_rank(df: DataFrame, value: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """1 + number of rows with a greater value, for every row."""
    per_value = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    src = _range_bucket(per_value, -F.col(value), parts)
    sizes = src.groupBy("__b").agg(F.sum("__n").alias("__m"))
    offsets = sizes.select(
        "__b",
        F.coalesce(
            F.sum("__m").over(
                Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("__off"),
    )
    inside = Window.partitionBy("__b").orderBy(F.col(value).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = (
        src.withColumn("__above", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "__b")
        .select(value, (F.col("__above") + F.col("__off") + 1).cast("bigint").alias(name))
    )
    return df.join(ranks, value)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    targets: Mapping[str, float | Callable[[Column], Column]],
    rank_of: str = "linear",
    parts: int | None = None,
) -> DataFrame:
    """Exact quantiles per group without gathering a group in one task.

    Values are pre-counted, cut into ranges, and only the ranges that hold a
    wanted rank are numbered.  ``rank_of``: ``linear`` interpolates at
    (n-1)*q; ``higher`` takes the ceil of that rank.  A target may be a function
    of the group's row count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n")
    )
    src = _range_bucket(counted, F.col(value).cast("double"), parts)
    sizes = src.groupBy(*keys, "__b").agg(F.sum("__n").alias("__m"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*keys)
    offsets = sizes.select(
        *keys,
        "__b",
        F.coalesce(F.sum("__m").over(upto), F.lit(0)).alias("__off"),
        F.sum("__m").over(whole).alias("__total"),
        "__m",
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(n).alias("t"),
                ((F.col("__total") - 1) * (
                    q(F.col("__total")) if callable(q) else F.lit(float(q))
                )).alias("r"),
            )
            for n, q in targets.items()
        ]
    )
    hits = (
        offsets.withColumn("__w", F.explode(wanted))
        .select(
            *keys, "__b", "__off", "__m",
            F.col("__w.t").alias("__t"),
            F.col("__w.r").alias("__r"),
        )
        .withColumn("__lo", F.floor("__r"))
        .withColumn("__hi", F.ceil("__r"))
        .where(
            F.col("__lo").between(F.col("__off"), F.col("__off") + F.col("__m") - 1)
            | F.col("__hi").between(F.col("__off"), F.col("__off") + F.col("__m") - 1)
        )
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    touched = hits.select(*keys, "__b").distinct()
    numbered = _semi(src, touched, [*keys, "__b"]).withColumn("__upto", F.sum("__n").over(inside))
    joined = _join_on(hits, numbered.select(*keys, "__b", value, "__n", "__upto"), [*keys, "__b"])
    first = F.col("__off") + F.col("__upto") - F.col("__n")
    last = F.col("__off") + F.col("__upto") - 1
    picks = joined.groupBy(*keys, "__t").agg(
        F.max("__r").alias("__r"),
        F.max(F.when(F.col("__lo").between(first, last), F.col(value))).alias("__vlo"),
        F.max(F.when(F.col("__hi").between(first, last), F.col(value))).alias("__vhi"),
    )
    frac = F.col("__r") - F.floor("__r")
    if rank_of == "higher":
        result = F.col("__vhi").cast("double")
    else:
        result = F.col("__vlo") + frac * (F.col("__vhi") - F.col("__vlo"))
    picks = picks.withColumn("__q", result)
    return picks.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__t") == n, F.col("__q"))).alias(n) for n in targets]
    )


def _semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    r = right.select(*[F.col(k).alias(f"__s_{k}") for k in keys])
    for k in keys:
        term = left[k].eqNullSafe(r[f"__s_{k}"])
        cond = term if cond is None else cond & term
    return left.join(r, cond, "left_semi")
