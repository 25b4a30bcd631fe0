"""Drive a machine over sessions, as a batch fold or as a stateful stream."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _out_schema(df: DataFrame, key: str, machine) -> T.StructType:
    # a machine with settings arrives as functools.partial
    parsed = T.StructType.fromDDL(getattr(machine, "func", machine).SCHEMA)
    return T.StructType([df.schema[key], *parsed.fields])


def fold_batch(df: DataFrame, key: str, order: list[str], inputs: list[str], machine: Callable,
               frames: Callable[[Column], Column] | None = None) -> DataFrame:
    """One pass per task over rows sorted by (session, order).

    A task holds one machine and one Arrow batch at a time, never a whole session. What a machine holds open at the
    end of its session comes from its ``finish``, where it has one.
    Sessions should be cut by time (a user's day, a recording), which bounds them. A machine with ``run`` is given neighbouring
    rows with equal inputs at once; Arrow finds them.

    With ``frames``, a row stands for several: the array of structs it makes of the row (a struct), each with its place first
    and then the inputs. Rows are sorted before they become frames; frames of rows with equal ``order`` are merged by place.
    """
    schema = _out_schema(df, key, machine)
    names = schema.names
    kind = getattr(machine, "func", machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        ended = lambda: [(current, *r) for r in getattr(state, "finish", list)()]
        for pdf in batches:
            rows = []
            for k, *values in pdf[[key, *inputs]].itertuples(index=False, name=None):
                if state is None or k != current:
                    rows += ended()
                    current, state = k, machine()
                rows += [(k, *r) for r in state.step(values)]
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(ended(), columns=names)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if frames is not None:
        alike = df.repartition(n, key).groupBy(key, *order).agg(F.collect_list(F.struct(*df.columns)).alias("_m"))
        made = F.when(F.size("_m") == 1, frames(F.get("_m", F.lit(0)))).otherwise(F.array_sort(F.flatten(F.transform("_m", frames))))
        given = alike.sortWithinPartitions(key, *order).select(key, made.alias("_f"))
        return given.mapInArrow(_runs(machine, inputs, getattr(kind, "MOVING", None), schema, True), schema)
    given = df.select(*dict.fromkeys([key, *order, *inputs])).repartition(n, key).sortWithinPartitions(key, *order)
    if hasattr(kind, "run"):
        return given.select(key, *inputs).mapInArrow(_runs(machine, inputs, getattr(kind, "MOVING", None), schema, False), schema)
    return given.mapInPandas(run, schema)


def _runs(machine: Callable, inputs: list[str], moving: int | None, schema: T.StructType, listed: bool) -> Callable:
    """Batches of (key, inputs), or (key, array of frames), to events; frames are alike if all but the ``moving`` input are equal."""
    target = to_arrow_schema(schema)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in target]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        ended = lambda: [(current, *r) for r in getattr(state, "finish", list)()]
        for batch in batches:
            if not batch.num_rows:
                continue
            held, at = batch.column(0), np.arange(batch.num_rows + 1)
            columns = batch.columns[1:]
            if listed:
                at = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())))
                flat = batch.column(1).flatten()
                columns = [pc.struct_field(flat, c) for c in inputs]
            ends = [ended_at(c) for i, c in enumerate(columns) if i != moving]
            ends = np.unique(np.concatenate([at[ended_at(held)], *ends]))
            ends = ends[ends > 0]
            if not len(ends):
                continue
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            of = held.take(pa.array(np.searchsorted(at, starts, "right") - 1))
            first = pa.table([of, *[c.take(pa.array(starts)) for c in columns]], names=[str(i) for i in range(len(columns) + 1)]).to_pandas()
            frames = None if moving is None else columns[moving].to_numpy(zero_copy_only=False)
            rows = []
            for i, j, (k, *values) in zip(starts.tolist(), ends.tolist(), first.itertuples(index=False, name=None)):
                if state is None or k != current:
                    rows += ended()
                    current, state = k, machine()
                rows += [(k, *r) for r in (state.run(values, j - i) if frames is None else state.run(values, j - i, frames[i:j]))]
            yield table(rows)
        yield table(ended())

    return run


def ended_at(column: pa.Array) -> np.ndarray:
    """Ends of the runs of equal neighbours."""
    return pc.run_end_encode(column).run_ends.to_numpy()


class _Session(StatefulProcessor):
    """Keeps the pickled machine of one session between micro-batches."""

    def __init__(self, key: str, order: list[str], inputs: list[str], machine: Callable, names: list[str]) -> None:
        self.key, self.order, self.inputs, self.machine, self.names = key, order, inputs, machine, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("blob", T.BinaryType())])
        self.state = handle.getValueState("machine", schema)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        kept = self.state.get()
        m = pickle.loads(kept[0]) if kept is not None else self.machine()
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for values in pdf[self.inputs].itertuples(index=False, name=None):
            out += [(*key, *r) for r in m.step(values)]
        self.state.update((pickle.dumps(m),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class _TimedSession(_Session):
    """Keeps the machine and the rows that the watermark has not passed; folds those in order, ends idle sessions.

    A machine that knows how long it is needed says so by ``until``, in milliseconds; others end when idle.
    """

    def __init__(self, *args, event_time: str, idle_ms: int) -> None:
        super().__init__(*args)
        self.event_time, self.idle_ms = event_time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def _load(self):
        kept = self.state.get()
        return pickle.loads(kept[0]) if kept is not None else (self.machine(), [], 0)

    def _end(self, m, last: int) -> int:
        return m.until() if hasattr(m, "until") else last + self.idle_ms

    def _fold(self, key, m, waiting, last, watermark):
        """Rows up to the watermark go through the machine; timers call back for the rest and for the end."""
        waiting.sort(key=lambda w: (w[0], w[1]))
        ready = [w for w in waiting if w[0] <= watermark]
        rest = waiting[len(ready):]
        out = [(*key, *r) for w in ready for r in m.step(w[2])]
        last = max([last, *(w[0] for w in ready)])
        self.handle.registerTimer(rest[-1][0] if rest else self._end(m, last))
        self.state.update((pickle.dumps((m, rest, last)),))
        return pd.DataFrame(out, columns=self.names)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        m, waiting, last = self._load()
        pdf = pd.concat(list(rows))
        at = pdf[self.event_time].astype("datetime64[ms]").astype("int64").tolist()
        order = pdf[self.order].itertuples(index=False, name=None)
        waiting += zip(at, order, map(tuple, pdf[self.inputs].itertuples(index=False, name=None)))
        yield self._fold(key, m, waiting, last, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.state.get() is None:
            yield pd.DataFrame([], columns=self.names)
            return
        m, waiting, last = self._load()
        if waiting or timerValues.getCurrentWatermarkInMs() < self._end(m, last):
            yield self._fold(key, m, waiting, last, timerValues.getCurrentWatermarkInMs())
            return
        self.state.clear()
        yield pd.DataFrame([(*key, *r) for r in getattr(m, "finish", list)()], columns=self.names)


def fold_stream(df: DataFrame, key: str, order: list[str], inputs: list[str], machine: Callable,
                event_time: str | None = None, late: str = "1 minute", idle_seconds: int = 1800) -> DataFrame:
    """The same machine on a stream.

    With ``event_time``, rows wait until the watermark passes them and are folded in order, rows later than it are
    dropped, and a session that is idle for ``idle_seconds`` is finished and forgotten. Without it, rows are folded as they
    arrive and a session never ends.
    """
    schema = _out_schema(df, key, machine)
    if event_time is None:
        processor = _Session(key, order, inputs, machine, schema.names)
        return df.groupBy(key).transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")
    processor = _TimedSession(key, order, inputs, machine, schema.names, event_time=event_time, idle_ms=idle_seconds * 1000)
    return df.withWatermark(event_time, late).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def ingest_new(spark, schema: T.StructType, source: str, target: str, checkpoint: str, transform=None):
    """Process only files not seen before; progress is committed with the output."""
    rows = spark.readStream.schema(schema).parquet(source)
    rows = transform(rows) if transform else rows
    q = (rows.writeStream.format("parquet").option("path", target)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def notify_new(rows: DataFrame, send: Callable, checkpoint: str):
    """Hand every micro-batch of new media rows to ``send`` as a DataFrame.

    A batch whose ``send`` fails, or whose job dies before its progress is written, is handed over again with the same
    rows and ``batch_id``, by which a receiver can drop the repeat.
    """
    q = (rows.writeStream.foreachBatch(lambda batch, i: send(batch.withColumn("batch_id", F.lit(i).cast("long"))))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
