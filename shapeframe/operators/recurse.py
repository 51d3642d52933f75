"""All levels of a recursive collection or chain of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import written
from ..plans.plan import Query
from ..plans.sqltext import quote
from .flat import aliased


def closure(q: Query, table: DataFrame, keys: DataFrame) -> DataFrame:
    """Each row below (or, for references, above) the keys once, with the query's aliases; of a collection with a depth, so many levels.

    Semi-naive: a round joins the links with the last round's keys only, and drops what was seen, so cycles end. Rounds
    are as many as levels; each is a shuffled or broadcast join, as Spark finds fit, and writes its new keys once. A
    round's plan is the same at every level: it reads written tables only.
    """
    spark, key, fk = table.sparkSession, quote(q.key_column), quote(q.link.fk)
    down, most = q.link.kind == "child", q.link.field.depth if q.link.kind == "child" else None
    links, _ = written(table.select(table[key].alias("_k"), table[fk].alias("_link")).where("_k IS NOT NULL"))
    frontier, _ = written(keys.select(F.col("key").alias("_f")).distinct())
    paths: list[str] = []
    while most is None or len(paths) < most:
        new = links.join(frontier, F.col("_link" if down else "_k") == F.col("_f"), "left_semi")
        new = new.select("_k", "_link").dropDuplicates(["_k"])
        if paths:
            new = new.join(spark.read.schema(links.schema).parquet(*paths).select("_k"), "_k", "left_anti")
        new, path = written(new)
        if new.isEmpty():
            break
        paths.append(path)
        frontier = new.select(F.col("_k").alias("_f")) if down else new.select(F.col("_link").alias("_f")).where("_f IS NOT NULL").distinct()
    columns = [aliased(c, table, None) for c in q.columns if c.role != "computed"]
    if not paths:
        return table.where(F.lit(False)).select(*columns)
    seen = spark.read.schema(links.schema).parquet(*paths).select(F.col("_k").alias("_seen"))
    return table.join(seen, table[key] == F.col("_seen"), "left_semi").select(*columns)


def cycle_members(table: DataFrame, key: str, parent: str) -> DataFrame:
    """Keys of the rows on cycles of their parent links: what remains when leaves are peeled off from both ends."""
    edges, _ = written(table.select(F.col(quote(key)).alias("k"), F.col(quote(parent)).alias("p")).where("k IS NOT NULL AND p IS NOT NULL"))
    while True:
        kept = edges.join(edges.select(F.col("k").alias("p")).distinct(), "p", "left_semi").select("k", "p")
        kept = kept.join(kept.select(F.col("p").alias("k")).distinct(), "k", "left_semi").select("k", "p")
        kept, _ = written(kept)
        if kept.count() == edges.count():
            return kept.select("k").distinct()
        edges = kept
