"""Loading a batch of roots at a time, and nested loads of micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import GraphRequired, SelectionWithoutJson
from ..lineage import cut
from ..operators.decode import Decoder, Record, to_json
from ..operators.flat import column, ordered
from ..operators.nest import VALUE
from ..plans.plan import Query, Repeat


#: Roots that the first load of a stream takes at least, and most that come to the driver at once unless a batch is larger.
FETCH = 1000
#: Times as many roots as the load before.
GROWTH = 8


def _batches(load: Any) -> Iterator[list[Record]]:
    """The keys are read once, with filter, order and page, and numbered; they stay on the executors.

    Many batches are one load by keys, with the filter again, so a root that went or changed before it is skipped. Each
    load takes GROWTH times as many roots as the one before: the tables are read a few times, not once for each batch,
    and the first values come soon. Its values stay on the executors, dealt by place, and come FETCH roots (or a batch)
    at a time. An error in a value ends the stream where its load begins. A view with fields of all levels is loaded a
    batch at a time, since their rows come to the driver whole. Numbering sorts by ranges and adds up the ranges' sizes:
    no single task holds all keys.
    """
    q = load.plan()
    rows = load.root(q)
    orders = [ordered(column(f"$order.{i}"), d) for i, (_, d) in enumerate(load.order)]
    keys = rows.select(*[column(f"$order.{i}") for i in range(len(load.order))], column(q.key_alias).alias("key"))
    parts = keys.orderBy(*orders, ordered(F.col("key"), False)).withColumn("_part", F.spark_partition_id())
    parts = cut(parts)
    inside = Window.partitionBy("_part").orderBy(*orders, ordered(F.col("key"), False))
    sizes = parts.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_part", "_start")
    numbered = parts.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(starts), "_part")
    # Rows of user SQL with equal keys are loaded once, together.
    numbered = cut(numbered.groupBy("key").agg(F.min(F.col("_start") + F.col("_n") - 1).alias("place")))
    total = (numbered.agg(F.max("place")).first()[0] or 0) + 1
    plain = load._with(keys=None, order=[], limit_=None, offset_=0)
    by_batch, start = _all_levels(q), 0
    many = load.batch if by_batch else -(-max(load.batch, FETCH) // load.batch) * load.batch
    while start < total:
        mine = numbered.where((F.col("place") >= start) & (F.col("place") < start + many))
        yield from _loaded(plain, mine, start, min(many, total - start), load.batch)
        start += many
        many *= 1 if by_batch else GROWTH


def _all_levels(q: Query) -> bool:
    found = [c for c in q.children.values() if not isinstance(c, Repeat)]
    return any(c is None or c.closure or _all_levels(c) for c in found)


def _loaded(plain: Any, mine: DataFrame, start: int, many: int, batch: int) -> Iterator[list[Record]]:
    """The values of some keys (key, place), a batch of places at a time; each batch is decoded on its own."""
    q, rows, ctx = plain.by_keys(mine).rows()
    plain.tables.spark.sparkContext.setJobDescription(f"shapeframe.stream {plain.view.name}")
    places = mine.select(F.col("key").alias("$place_of"), F.col("place").alias("$place"))
    at_once = max(batch, FETCH)
    rows = rows.join(places, column(q.key_alias) == column("$place_of")).drop("$place_of")
    rows = rows.repartitionById(-(-many // at_once), ((column("$place") - start) / at_once).cast("int")).sortWithinPartitions(column("$place"))
    levels = {name: plain._run(df.collect) for name, df in ctx.closures.items()}
    found = plain._run(rows.toLocalIterator)
    rest = iter(lambda: plain._run(lambda: next(found, None)), None)
    for _, some in groupby(rest, lambda r: r["$place"] // batch):
        decoder = Decoder(levels)
        yield [decoder.value(q, r[VALUE], r, ()) for r in some]


def stream(load: Any) -> Iterator[Record]:
    if load.selection is not None:
        raise SelectionWithoutJson(load.view.name, "", "a selection leaves fields out, so only json() and frame() can give it")
    if load.view.has_graph_edges():
        raise GraphRequired(load.view.name, "", "a view with references into a graph isn't streamed")
    return (v for batch in _batches(load) for v in batch)


def json_stream(load: Any) -> Iterator[Any]:
    if load.view.has_graph_edges() and load.selection is None:
        raise GraphRequired(load.view.name, "", "a view with references into a graph is streamed with a selection")
    return (to_json(v, load.view.fields, load.view.name) for batch in _batches(load) for v in batch)


def each_micro_batch(source: DataFrame, load: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs a load over each micro-batch of a stream: load gets the batch as a table and gives the nested frame to write."""
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(load(batch), n))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Rows per window and key of a stream, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("count"))
