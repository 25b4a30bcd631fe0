"""Recursive filters over tracks of any length: segments that hand their state on.

A filter's state after a row follows from the state before and the row. Tracks are cut into segments, and each is folded twice:
from its own first row, and from where the segment before then ended. Where both ends agree, the state no longer
depends on what was further away, and every segment is right. Tracks on which some ends differ are cut again into segments four
times as long, until they agree or a segment is the whole track. Folds carry the state alone; only pieces of ``SPAN`` rows,
whose entry is known by then, collect rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions.vectors import let
from tracklore.session import written

SPAN = 256


def filtered(frames: DataFrame, keys: list[str], order: str, row: Column, state: str, step: Callable, same: Callable | None = None,
             span: int = SPAN) -> DataFrame:
    """(keys, order, s, n): the state after every row, and the number of rows of its track.

    ``step(s, r, after)`` gives the next state from the state (null before the first row), the row and the row behind it (null
    behind the last); ``state`` is its DDL type. ``same(a, b)`` tells when two states are as good as equal.
    """
    same = same or (lambda a, b: a.eqNullSafe(b))
    none = F.lit(None).cast(state)
    w = Window.partitionBy(*keys).orderBy("_seg")
    whole = Window.partitionBy(*keys)
    todo, done, width = frames.select(*keys, F.col(order).alias("_o"), row.alias("_r")), [], span

    def folded(entry):
        return F.aggregate("_p", entry, lambda s, x: step(s, x["r"], x["after"]).cast(state))

    def marked(entry):
        """The state after all rows, and the states before row 0, span, 2 span ..."""
        start = F.struct(entry.alias("s"), F.array().cast(f"array<{state}>").alias("marks"), F.lit(0).alias("i"))
        return F.aggregate("_p", start, lambda acc, x: F.struct(
            step(acc["s"], x["r"], x["after"]).cast(state).alias("s"),
            F.when(acc["i"] % span == 0, F.concat(acc["marks"], F.array(acc["s"]))).otherwise(acc["marks"]).alias("marks"),
            (acc["i"] + 1).alias("i")))

    while True:
        segs = todo.groupBy(*keys, F.floor(F.col("_o") / width).alias("_seg")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_r").alias("r")))).alias("_p"))
        segs = segs.withColumn("_after", F.lead(F.get("_p", F.lit(0))["r"]).over(w))
        segs = segs.withColumn("_p", F.transform("_p", lambda x, i: F.struct(
            x["o"].alias("o"), x["r"].alias("r"), F.when(i + 1 < F.size("_p"), F.get("_p", i + 1)["r"]).otherwise(F.col("_after")).alias("after"))))
        segs = written(segs.withColumn("_guess", folded(none)))
        segs = segs.withColumn("_m", marked(F.lag("_guess").over(w))).withColumn("_n", F.sum(F.size("_p")).over(whole))
        segs = written(segs.withColumn("_good", F.min(same(F.col("_m.s"), F.col("_guess"))).over(whole)))
        done.append(segs.where("_good").select(*keys, "_p", "_m.marks", "_n"))
        open_ = segs.where("not _good")
        if open_.isEmpty():
            break
        todo = open_.select(*keys, F.explode("_p").alias("_x")).select(*keys, F.col("_x.o").alias("_o"), F.col("_x.r").alias("_r"))
        width *= 4
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    pieces = rows.select(*keys, "_n", "_p", F.posexplode("marks").alias("_k", "_s"))
    pieces = pieces.select(*keys, "_n", "_s", F.slice("_p", F.col("_k") * span + 1, F.lit(span)).alias("_p"))
    out = f"array<struct<o: {frames.schema[order].dataType.simpleString()}, s: {state}>>"
    start = F.struct(F.col("_s").alias("s"), F.array().cast(out).alias("out"))
    all_states = F.aggregate("_p", start, lambda acc, x: let(step(acc["s"], x["r"], x["after"]).cast(state), lambda s: F.struct(
        s.alias("s"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), s.alias("s")))).alias("out"))))["out"]
    return pieces.select(*keys, "_n", F.explode(all_states).alias("_e")).select(*keys, F.col("_e.o").alias(order), F.col("_e.s").alias("s"), F.col("_n").alias("n"))
