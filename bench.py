"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def timed(run, times: int = 3) -> float:
    """The median of some runs after a first one."""
    run()
    out = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        out.append(time.perf_counter() - start)
    return round(statistics.median(out), 3)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from shapeframe import queries as q
    from shapeframe.functions import Nested
    from shapeframe.operators.load import Load
    from shapeframe.shapes import BIGINT, STRING, Child, Column, View
    from shapeframe.sources.store import Store

    write = lambda df: df.write.format("noop").mode("overwrite").save()
    found: dict[str, float] = {}
    ratios: dict[str, float] = {}

    # The same rows by hand, without this engine: what the nested form costs more than plain DataFrame code.
    def by_hand():
        t = q.tables(spark, folder)
        lines = t.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_quantity")).alias("lines"))
        write(t.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "lines"))

    plain = View("Order", "orders", {**q.Order.fields, "lines": Child(q.Line, "l_orderkey")}, key="o_orderkey")
    found["nested_load"] = timed(lambda: write(Load(plain, q.tables(spark, folder)).frame()))
    found["nested_load_by_hand"] = timed(by_hand)
    ratios["overhead_ratio"] = round(found["nested_load"] / found["nested_load_by_hand"], 3)
    found["top_n_per_parent"] = timed(lambda: write(Load(q.OrderLines, q.tables(spark, folder)).nested("lines", Nested().limit(3)).frame()))
    found["selection_pruning"] = timed(lambda: write(Load(q.OrderLines, q.tables(spark, folder)).select("id").frame()))
    for name in ("to_one_chain", "child_two_siblings", "child_grandchild", "through_list", "union_table_per_variant", "tree_closure", "report_with_child", "dearest_orders"):
        found[name] = timed(lambda name=name: write(q.QUERIES[name](spark, folder)))

    # 11,000 rows: 1,000 values of 10 elements.
    import tempfile

    sub = View("Subtask", "subtask", {"id": Column(BIGINT), "name": Column(STRING)})
    task = View("Task", "task", {"id": Column(BIGINT), "name": Column(STRING), "subtasks": Child(sub, "task_id", index="position")})
    store = Store(spark, tempfile.mkdtemp())
    store.create(task=spark.createDataFrame([], "id long, name string"), subtask=spark.createDataFrame([], "id long, task_id long, name string, position int"))
    values = [{"id": i, "name": f"t{i}", "subtasks": [{"id": 10 * i + j, "name": f"s{j}"} for j in range(10)]} for i in range(1000)]
    found["save_all"] = timed(lambda: store.save_all(task, values), 2)

    try:
        from shapeframe.llm import queries as llm
    except ModuleNotFoundError:
        llm = None
    for name in llm.QUERIES if llm else ():
        found[name] = timed(lambda name=name: write(llm.QUERIES[name](spark, folder)), 1)
    total = round(sum(v for k, v in found.items() if k != "nested_load_by_hand"), 3)
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": found, "ratios": ratios, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
