"""Registered queries see every row of their tables, not those of a range of ids."""

import os

import pytest
from pyspark.sql import functions as F

from shapeframe.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_overrides_of_all_customers(spark, tmp_path):
    for name in ("customer", "orders"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").where("true" if name == "customer" else "o_orderstatus <> 'P' OR o_custkey >= 100").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = QUERIES["shadow_mismatch"](spark, str(tmp_path)).first()
    assert (got.runs, got.mismatches) == (1, 1)
    wanted = spark.read.parquet(str(tmp_path / "orders.parquet")).where("o_totalprice > 1000")
    assert QUERIES["override_child"](spark, str(tmp_path)).agg(F.count("*"), F.max("customer")).first() == wanted.agg(F.count("*"), F.max("o_custkey")).first()


def test_recursion_from_all_parts(spark):
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").count()
    tree, mutual = QUERIES["tree_depth"](spark, FOLDER), QUERIES["mutual_recursion"](spark, FOLDER)
    assert tree.select("child").distinct().count() == parts - 1
    assert mutual.agg(F.max("id")).first()[0] == (parts - 1) // 16 and mutual.count() == parts - 4


def test_graph_of_all_customers(spark):
    customers, orders = (spark.read.parquet(f"{FOLDER}/{n}.parquet").count() for n in ("customer", "orders"))
    found = dict(QUERIES["graph_component"](spark, FOLDER).groupBy("view").count().collect())
    assert (found["Customer"], found["Order"]) == (customers, orders)
    edges = dict(QUERIES["graph_edges"](spark, FOLDER).groupBy("edge").count().collect())
    assert (edges["Customer.orders"], edges["Order.customer"], edges["Customer.nation"]) == (orders, orders, customers)
    last = spark.read.parquet(f"{FOLDER}/part.parquet").agg(F.max("p_partkey")).first()[0]
    chain = [last]
    while chain[-1]:
        chain.append(chain[-1] // 4)
    assert sorted(r.k for r in QUERIES["cycle_detected"](spark, FOLDER).collect()) == sorted(chain)
