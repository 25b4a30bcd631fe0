"""Near copies across splits: clips of one signer and source whose windows overlap and whose trajectories are close."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.functions.vectors import let, total

QUARTERS = 4
PACK = 512, 2048  # rows of a pack of either side
SIDE = ["clip", "copies", "split", "start", "end", "path"]


def standard(path: Column | str) -> Column:
    """A trajectory without place and size: mean 0, mean square 1; one that stands still becomes zeros."""
    path = F.col(path) if isinstance(path, str) else path
    centred = let(path, lambda p: let(total(p) / F.size(p), lambda m: F.transform(p, lambda x: x - m)))
    size = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c))
    return let(centred, lambda c: let(size(c), lambda s: F.transform(c, lambda x: F.when(s > 0, x / s).otherwise(0.0))))


def resampled(path: Column | str, points: int) -> Column:
    """A trajectory of any length of at least one value at ``points`` even places, by straight lines between its values."""
    path = F.col(path) if isinstance(path, str) else path

    def at(p, i):
        where = i * (F.size(p) - 1) / F.lit(max(1, points - 1))
        return let(F.floor(where).cast("int"), lambda k: F.get(p, k) + (where - k) * (
            F.get(p, F.least(k + 1, F.size(p) - 1)) - F.get(p, k)))

    return let(path, lambda p: F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: at(p, i)))


def rms(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a))


def part_means(path: Column | str, parts: int) -> Column:
    """Means of ``parts`` even parts of a trajectory whose length they divide."""
    path = F.col(path) if isinstance(path, str) else path
    return let(path, lambda p: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: let(
        (F.size(p) / parts).cast("int"), lambda n: total(F.slice(p, i * n + 1, n)) / n)))


def trajectory_leaks(clips: DataFrame, limit: float, bucket: float, points: int = 64) -> DataFrame:
    """Clips of different splits with one source and signer, overlapping windows and trajectories at most ``limit`` apart.

    ``clips`` has clip_id, split, source, signer, start, end (half open) and path, an array of doubles of any length; paths
    are brought to ``points`` values (a multiple of 16), mean 0 and mean square 1, and compared by the root of their mean squared
    difference. Equal trajectories of one window and split are one row with its count of copies and smallest clip_id, so copies are
    never paired. Each pair of such rows is given once, its splits in order.

    Two rows meet on (source, signer, time bucket, cell): a window lies in every bucket that it touches, and a pair counts only
    in the bucket where its overlap begins, so nothing is made distinct afterwards. Means of a quarter differ by at most
    sqrt(4) times the distance, hence rows within the limit lie in neighbouring cells of the first two quarters' means.
    Rows that meet are compared pack by pack, so a task holds two packs however many rows share a key. The choice of ``bucket``
    (best about the length of a clip) never changes the result. Rows with a null in source, signer, window, split or path, an
    empty path, a path with a null or NaN in it, or an empty window match nothing.
    """
    sound = F.col("path").isNotNull() & (F.size("path") > 0) & ~F.exists("path", lambda x: x.isNull() | F.isnan(x))
    rows = clips.where(sound & (F.col("start") < F.col("end")) & F.col("split").isNotNull() & F.col("source").isNotNull() & F.col("signer").isNotNull())
    shape = rows.select("clip_id", "split", "source", "signer", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"),
                        standard(resampled("path", points)).alias("path"))
    one = shape.groupBy("split", "source", "signer", "start", "end", "path").agg(
        F.min("clip_id").alias("clip"), F.count(F.lit(1)).alias("copies"))
    width = limit * QUARTERS ** 0.5 * (1 + 1e-9)
    quarter = part_means("path", QUARTERS)
    keyed = one.withColumn("quarter", quarter).withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    cell = [F.floor(F.get("quarter", F.lit(i)) / width) for i in (0, 1)]
    keys = ["source", "signer", "bucket", "cell_0", "cell_1"]
    a = keyed.select(*SIDE, *keys[:3], cell[0].alias("cell_0"), cell[1].alias("cell_1"))
    around = lambda c: F.explode(F.sequence(c - 1, c + 1))
    b = keyed.select(*SIDE, *keys[:3], "quarter", around(cell[0]).alias("cell_0"))
    b = b.select(*SIDE, *keys[:4], around(cell[1]).alias("cell_1"))
    ends = one.agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    met = _packed(b.where(F.col("split") > ends.select("lo").scalar()), keys, "b", PACK[1])
    here = _packed(a.where(F.col("split") < ends.select("hi").scalar()), keys, "a", PACK[0]).join(met.groupBy(*keys).agg(F.max("b_pack").alias("last")), keys)
    met = here.withColumn("b_pack", F.explode(F.sequence(F.lit(0), "last"))).join(met, [*keys, "b_pack"])
    kind = {f.name: f.dataType for f in one.schema}
    schema = T.StructType([T.StructField(n, t) for n, t in {
        "source": kind["source"], "signer": kind["signer"], "clip": kind["clip"], "other": kind["clip"], "split": kind["split"], "other_split": kind["split"],
        "overlap": T.DoubleType(), "distance": T.DoubleType(), "copies": T.LongType(), "other_copies": T.LongType()}.items()])
    return met.select("source", "signer", "bucket", "a", "b").mapInArrow(lambda batches: _close(batches, limit, bucket), schema)


def _packed(rows: DataFrame, keys: list[str], side: str, size: int) -> DataFrame:
    """Rows of equal keys in packs of about ``size``: keys, number of the pack, array of its rows."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("__n"))
    dealt = rows.join(n, keys).withColumn(f"{side}_pack", F.pmod(F.xxhash64("clip", "split", "start", "end"), F.col("__n")).cast("int"))
    return dealt.groupBy(*keys, f"{side}_pack").agg(F.collect_list(F.struct(*SIDE)).alias(side))


def _close(batches: Iterator[pa.RecordBatch], limit: float, bucket: float) -> Iterator[pa.RecordBatch]:
    """Close pairs of two packs: a product of matrices leaves few pairs, which are then measured as written."""
    for batch in batches:
        for r in range(batch.num_rows):
            a, b = (dict(zip(SIDE, batch.column(c).slice(r, 1).flatten().flatten())) for c in (3, 4))
            start, end, order = ([side[c].to_numpy(zero_copy_only=False) for side in (a, b)] for c in ("start", "end", "split"))
            path = [side["path"].flatten().to_numpy().reshape(len(side["clip"]), -1) for side in (a, b)]
            begin = np.maximum(start[0][:, None], start[1])
            size = [np.einsum("ij,ij->i", p, p) for p in path]
            near = size[0][:, None] + size[1] - 2 * path[0] @ path[1].T
            slack = 1e-9 * (limit * limit * path[0].shape[1] + size[0][:, None] + size[1])
            i, j = np.nonzero((near <= limit * limit * path[0].shape[1] + slack) & (begin < np.minimum(end[0][:, None], end[1]))
                              & (np.floor(begin / bucket) == batch.column(2)[r].as_py()))
            total = np.zeros(len(i))
            for x, y in zip(path[0].T, path[1].T):
                total += (x[i] - y[j]) * (x[i] - y[j])
            distance = np.sqrt(total / path[0].shape[1])
            ok = (distance <= limit) & (order[0][i] < order[1][j]).astype(bool)
            i, j, distance = i[ok], j[ok], distance[ok]
            one, two = pa.array(i), pa.array(j)
            same = pa.array(np.full(len(i), r))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(same), batch.column(1).take(same), a["clip"].take(one), b["clip"].take(two), a["split"].take(one), b["split"].take(two),
                pa.array(np.minimum(end[0][i], end[1][j]) - begin[i, j]), pa.array(distance), a["copies"].take(one), b["copies"].take(two)],
                names=["source", "signer", "clip", "other", "split", "other_split", "overlap", "distance", "copies", "other_copies"])
