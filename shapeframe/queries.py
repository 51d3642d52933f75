"""One query for each operator, over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import Condition, Nested, col
from .gql import GraphApi
from .lineage import shared_folder
from .operators.graph import reach
from .operators.load import Load
from .operators.recurse import cycle_members
from .registry import Registry
from .shapes import (
    BIGINT,
    FLOAT,
    INT,
    NAIVE_DATETIME,
    STRING,
    Child,
    Column,
    Embed,
    Embedded,
    Sum,
    ToOne,
    Variant,
    View,
    list_of,
    optional,
)
from .sources.schema import snapshot
from .sources.store import Store, merge, save_frame
from .sources.tables import Tables
from .streaming.batches import each_micro_batch

Query = Callable[[SparkSession, str], DataFrame]

Nation = View("Nation", "nation", {"id": Column(INT, "n_nationkey"), "name": Column(STRING, "n_name"), "region_id": Column(INT, "n_regionkey")}, key="n_nationkey")
Region = View("Region", "region", {"id": Column(INT, "r_regionkey"), "name": Column(STRING, "r_name"), "nations": Child(Nation, "n_regionkey")}, key="r_regionkey")
Line = View("Line", "lineitem", {"number": Column(INT, "l_linenumber"), "price": Column(FLOAT, "l_extendedprice"), "part_id": Column(BIGINT, "l_partkey"), "quantity": Column(FLOAT, "l_quantity")}, key="l_linenumber")
LineByPrice = Child(Line, "l_orderkey", order_by="l_extendedprice desc, l_partkey, l_quantity")
RegionOnly = View("Region", "region", {"id": Column(INT, "r_regionkey"), "name": Column(STRING, "r_name")}, key="r_regionkey")
NationUp = View("Nation", "nation", {"id": Column(INT, "n_nationkey"), "name": Column(STRING, "n_name"), "region": ToOne(RegionOnly, "n_regionkey")}, key="n_nationkey")
CustomerUp = View("Customer", "customer", {"id": Column(BIGINT, "c_custkey"), "name": Column(STRING, "c_name"), "segment": Column(STRING, "c_mktsegment"), "nation": ToOne(NationUp, "c_nationkey")}, key="c_custkey")
Order = View("Order", "orders", {"id": Column(BIGINT, "o_orderkey"), "total": Column(FLOAT, "o_totalprice"), "status": Column(STRING, "o_orderstatus"), "date": Column(NAIVE_DATETIME, "o_orderdate")}, key="o_orderkey")
OrderLines = View("Order", "orders", {**Order.fields, "lines": LineByPrice}, key="o_orderkey")
OrderUp = View("Order", "orders", {**Order.fields, "customer": ToOne(CustomerUp, "o_custkey"), "lines": LineByPrice}, key="o_orderkey")
Customer = View("Customer", "customer", {"id": Column(BIGINT, "c_custkey"), "name": Column(STRING, "c_name"), "balance": Column(FLOAT, "c_acctbal"), "segment": Column(STRING, "c_mktsegment")}, key="c_custkey")
CustomerOrders = View("Customer", "customer", {**Customer.fields, "orders": Child(Order, "o_custkey", order_by="o_totalprice desc")}, key="c_custkey")
CustomerTree = View("Customer", "customer", {**Customer.fields, "orders": Child(OrderLines, "o_custkey")}, key="c_custkey")
Supplier = View("Supplier", "supplier", {"id": Column(BIGINT, "s_suppkey"), "name": Column(STRING, "s_name")}, key="s_suppkey")
NationAll = View("Nation", "nation", {"id": Column(INT, "n_nationkey"), "customers": Child(Customer, "c_nationkey"), "suppliers": Child(Supplier, "s_nationkey")}, key="n_nationkey")
Part = View("Part", "part", {"id": Column(BIGINT, "p_partkey"), "name": Column(STRING, "p_name"), "size": Column(INT, "p_size")}, key="p_partkey")
OrderParts = View("Order", "orders", {**Order.fields, "parts": Child(Part, "l_orderkey", through="lineitem", target="l_partkey", order_by="p_name")}, key="o_orderkey")
SupplierParts = View("Supplier", "supplier", {**Supplier.fields, "parts": Child(Part, "l_suppkey", through="lineitem", target="l_partkey")}, key="s_suppkey")
Turn = View("Turn", "conversations", {"turn": Column(BIGINT), "role": Column(STRING)}, key="turn")
Conversation = View("Conversation", "conversation", {"id": Column(BIGINT), "turns": Child(Turn, "conv_id", index="turn")}, key="id")
Label = View("Label", "labels", {"id": Column(BIGINT, "doc_id"), "quality": Column(INT), "toxic": Column(INT)}, key="doc_id")
Document = View("Document", "documents_labels", {"id": Column(BIGINT, "doc_id"), "source": Column(STRING), "label": ToOne(Label, "label_id", optional=True)}, key="doc_id")
Price = Embedded("Price", {"extended": Column(FLOAT, "extendedprice"), "terms": Embed(Embedded("Terms", {"discount": Column(FLOAT), "tax": Column(FLOAT)}))})
PricedLine = View("Line", "lineitem", {"order": Column(BIGINT, "l_orderkey"), "price": Embed(Price, "l_")}, key="l_orderkey")
Event = View(
    "Event", "event_rows", {"id": Column(BIGINT, "event_id"), "kind": Embed(Sum("Kind", "event_type", tuple(Variant(n.title(), {"amount": Column(optional(FLOAT), "amount")} if n == "purchase" else {}, n) for n in ("click", "error", "purchase", "signup", "view"))))}, key="event_id"
)
LenientEvent = View("Event", "event_rows", {"id": Column(BIGINT, "event_id"), "kind": Embed(Sum("Kind", "event_type", Event.fields["kind"].shape.variants, lenient=True))}, key="event_id")
StateOrder = View(
    "Order",
    "orders",
    {"id": Column(BIGINT, "o_orderkey"), "state": Embed(Sum("State", "o_orderstatus", (Variant("Filled", {"total": Column(FLOAT, "o_totalprice")}, "F", "orders_f", "o_orderkey"), Variant("Open", {"priority": Column(STRING, "o_orderpriority")}, "O", "orders_o", "o_orderkey"), Variant("Pending", {}, "P")), table_per_variant=True))},
    key="o_orderkey",
)


def tree(depth: int | None) -> View:
    return View("Node", "part_tree", {"id": Column(BIGINT), "name": Column(STRING), "children": Child("self", "parent_id", depth=depth, recursive=depth is None)})


Chain = View("Node", "part_tree", {"id": Column(BIGINT), "parent": ToOne("self", "parent_id", optional=True, depth=3)})
Even = View("Even", "part_tree", {"id": Column(BIGINT), "odds": Child(lambda: Odd, "parent_id")})
Odd = View("Odd", "part_tree", {"id": Column(BIGINT), "evens": Child(lambda: Even, "parent_id", depth=1)})
Vector = View("Vector", "embeddings", {"id": Column(BIGINT, "vec_id"), "values": Column(list_of(FLOAT), "embedding")}, key="vec_id")
GraphPart = View("Part", "part", {"id": Column(BIGINT, "p_partkey")}, key="p_partkey")
GraphOrder = View("Order", "orders", {"id": Column(BIGINT, "o_orderkey"), "customer": ToOne(lambda: GraphCustomer, "o_custkey", graph=True), "parts": Child(GraphPart, "l_orderkey", through="lineitem", target="l_partkey", graph=True)}, key="o_orderkey")
GraphCustomer = View("Customer", "customer", {"id": Column(BIGINT, "c_custkey"), "nation": ToOne(lambda: GraphNation, "c_nationkey", graph=True), "orders": Child(GraphOrder, "o_custkey", graph=True)}, key="c_custkey")
GraphNation = View("Nation", "nation", {"id": Column(INT, "n_nationkey"), "name": Column(STRING, "n_name")}, key="n_nationkey")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The test tables, and shapes that they lack, derived from them."""
    t = Tables(spark, sf_dir)
    read = t.table
    return t.with_tables(
        conversation=lambda: read("conversations").select(F.col("conv_id").alias("id")).distinct(),
        documents_labels=lambda: read("documents").join(read("labels").select(F.col("doc_id").alias("label_id")), F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "source", "label_id"),
        part_tree=lambda: read("part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey div 4 END AS parent_id", "p_name AS name"),
        event_rows=lambda: read("events").selectExpr("event_id", "event_type", "CASE WHEN event_type = 'purchase' OR event_id % 50 = 0 THEN value END AS amount"),
        orders_f=lambda: read("orders").where("o_orderstatus = 'F'"),
        orders_o=lambda: read("orders").where("o_orderstatus = 'O'"),
        part_ring=lambda: read("part").crossJoin(read("part").agg(F.max("p_partkey").alias("last"))).selectExpr("p_partkey AS id", "CASE WHEN p_partkey = 0 THEN last ELSE p_partkey div 4 END AS next_id"),
    )


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(view: View, t: Tables) -> Load:
    return Load(view, t)


# Scans, order, pages ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def root_scan(t):
    return load(Customer, t).frame()


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 40")
def root_order_page(t):
    return load(Order, t).order_by_desc("o_totalprice").limit(20).offset(40).frame().select("id", "total")


@query("SELECT c_custkey AS id FROM customer ORDER BY c_acctbal, c_custkey OFFSET 1000")
def root_offset_only(t):
    return load(Customer, t).order_by("c_acctbal").offset(1000).frame().select("id")


def _filter(name: str, view: View, condition: Condition, sql: str) -> None:
    key = view.key_field
    QUERIES[name] = lambda spark, sf_dir: load(view, tables(spark, sf_dir)).filter(condition).frame().select(key)
    ORACLE_SQL[name] = f"SELECT {view.key} AS {key} FROM {sql}"


_filter("filter_compare", Part, col("p_size").ge(10) & col("p_size").lt(30) & col("p_size").ne(20) & (col("p_partkey").gt(5) | col("p_partkey").le(2)) & ~col("p_size").eq(11), "part WHERE p_size >= 10 AND p_size < 30 AND p_size <> 20 AND (p_partkey > 5 OR p_partkey <= 2) AND NOT p_size = 11")
_filter("filter_null", Document, col("label_id").is_null(), "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_filter("filter_not_null", Document, col("label_id").is_not_null(), "documents WHERE doc_id IN (SELECT doc_id FROM labels)")
_filter("filter_in", Part, col("p_size").is_in([1, 5, 9]), "part WHERE p_size IN (1, 5, 9)")
_filter("filter_not_in", Document, col("label_id").not_in([1, 2, 3]), "documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (1, 2, 3)")
_filter("filter_in_empty", Part, col("p_size").is_in([]), "part WHERE false")
_filter("filter_not_in_empty", Document, col("label_id").not_in([]), "documents")
_filter("filter_like", Customer, col("c_name").like("%1_"), "customer WHERE c_name LIKE '%1_'")
_filter("filter_ilike", Customer, col("c_mktsegment").ilike("build%"), "customer WHERE c_mktsegment ILIKE 'build%'")
_filter("filter_bool_tree", Customer, (Condition.any([col("c_mktsegment").eq("BUILDING"), col("c_acctbal").lt(0.0)]) & ~col("c_nationkey").is_in([1, 2])) & Condition.all([]), "customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT c_nationkey IN (1, 2)")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (3, 5, 8, 13) AND c_acctbal > 0")
def by_keys(t):
    return load(Customer, t).by_keys([3, 5]).by_keys([8, 13, 999_999_999]).filter(col("c_acctbal").gt(0)).frame().select("id", "name")


@query("SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def keys_projection(t):
    return load(Customer, t).filter(col("c_mktsegment").eq("BUILDING")).order_by_desc("c_acctbal").limit(50).key_frame()


@query("SELECT count(*) AS count FROM customer WHERE c_acctbal > 100")
def count_filtered(t):
    return load(Customer, t).filter(col("c_acctbal").gt(100)).order_by("c_name").limit(3).count_frame()


# Embedded values and keys -------------------------------------------------------------------------------------------


@query('SELECT l_orderkey AS "order", l_extendedprice AS extended, l_discount AS discount, l_tax AS tax FROM lineitem')
def embed_prefix(t):
    return load(PricedLine, t).frame().select("order", "price.extended", "price.terms.discount", "price.terms.tax")


@query('SELECT n_name AS name, n_nationkey AS "$key" FROM nation')
def key_alias(t):
    return load(View("Nation", "nation", {"name": Column(STRING, "n_name")}, key="n_nationkey"), t).flat()


@query("SELECT vec_id AS id, len(embedding)::BIGINT AS n, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings")
def list_column(t):
    return load(Vector, t).frame().select("id", F.size("values").cast("long").alias("n"), F.round(F.col("values")[0].cast("double"), 4).alias("first"))


# Collections --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS customer, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) - 1 AS place, o_orderkey AS id FROM customer JOIN orders ON o_custkey = c_custkey")
def child_list(t):
    return load(CustomerOrders, t).frame().select(F.col("id").alias("customer"), F.posexplode("orders").alias("place", "o")).select("customer", F.col("place").cast("long").alias("place"), "o.id")


@query("SELECT r_regionkey AS region, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name DESC NULLS FIRST, n_nationkey) - 1 AS place, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
def child_order_desc(t):
    v = View("Region", "region", {**Region.fields, "nations": Child(Nation, "n_regionkey", order_by="n_name desc")}, key="r_regionkey")
    return load(v, t).frame().select(F.col("id").alias("region"), F.posexplode("nations").alias("place", "n")).select("region", F.col("place").cast("long").alias("place"), "n.name")


@query("SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey")
def child_empty(t):
    return load(CustomerOrders, t).nested("orders", Nested().filter(col("o_totalprice").gt(400000.0))).frame().select("id", F.size("orders").cast("long").alias("n"))


@query("SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def child_two_siblings(t):
    return load(NationAll, t).frame().select("id", F.size("customers").cast("long").alias("customers"), F.size("suppliers").cast("long").alias("suppliers"))


@query("SELECT c_custkey AS customer, o_orderkey AS id, count(l_orderkey) AS lines, coalesce(round(sum(l_extendedprice), 2), 0) AS price FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey, o_orderkey")
def child_grandchild(t):
    o = load(CustomerTree, t).frame().select(F.col("id").alias("customer"), F.explode("orders").alias("o"))
    total = F.aggregate("o.lines", F.lit(0.0), lambda a, x: a + x["price"])
    return o.select("customer", "o.id", F.size("o.lines").cast("long").alias("lines"), F.round(total, 2).alias("price"))


@query("SELECT o_orderkey AS id, c_name AS customer, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def to_one_chain(t):
    v = View("Order", "orders", {"id": Column(BIGINT, "o_orderkey"), "customer": ToOne(CustomerUp, "o_custkey")}, key="o_orderkey")
    return load(v, t).frame().select("id", F.col("customer.name").alias("customer"), F.col("customer.nation.name").alias("nation"), F.col("customer.nation.region.name").alias("region"))


@query("SELECT d.doc_id AS id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def to_one_optional(t):
    return load(Document, t).frame().select("id", F.col("label.quality").cast("long").alias("quality"), F.col("label.toxic").cast("long").alias("toxic"))


@query("SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_name, p_partkey) - 1 AS place, p_partkey AS part FROM lineitem JOIN part ON p_partkey = l_partkey")
def through_list(t):
    return load(OrderParts, t).frame().select("id", F.posexplode("parts").alias("place", "p")).select("id", F.col("place").cast("long").alias("place"), F.col("p.id").alias("part"))


@query("SELECT l_suppkey AS id, count(*) AS parts, count(DISTINCT l_partkey) AS distinct_parts FROM lineitem GROUP BY l_suppkey")
def through_duplicates(t):
    s = load(SupplierParts, t).frame().where(F.size("parts") > 0)
    return s.select("id", F.size("parts").cast("long").alias("parts"), F.size(F.array_distinct(F.transform("parts", lambda p: p["id"]))).cast("long").alias("distinct_parts"))


@query("SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, turn, role FROM conversations")
def list_index(t):
    return load(Conversation, t).frame().select("id", F.posexplode("turns").alias("place", "x")).select("id", F.col("place").cast("long").alias("place"), "x.turn", "x.role")


@query("SELECT 'ListIndex' AS code, l_orderkey::VARCHAR AS key FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_linenumber)")
def list_index_violation(t):
    v = View("Order", "orders", {"id": Column(BIGINT, "o_orderkey"), "lines": Child(Line, "l_orderkey", index="l_linenumber")}, key="o_orderkey")
    return load(v, t).violations().select("code", "key")


@query("SELECT r_name AS region, n_name AS name, n_nationkey AS id FROM region JOIN nation ON n_regionkey = r_regionkey")
def map_by_column(t):
    v = View("Region", "region", {"name": Column(STRING, "r_name"), "nations": Child(Nation, "n_regionkey", key="n_name")}, key="r_regionkey")
    return load(v, t).frame().select(F.col("name").alias("region"), F.explode("nations").alias("name", "n")).select("region", "name", "n.id")


# Nested arguments ---------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS customer, o_orderkey AS id, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) - 1 AS place FROM orders) WHERE place < 3")
def nested_top_n(t):
    o = load(CustomerOrders, t).nested("orders", Nested().limit(3)).frame().select(F.col("id").alias("customer"), F.posexplode("orders").alias("place", "o"))
    return o.select("customer", "o.id", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey AS customer, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS r FROM orders) WHERE r > 2 AND r <= 4")
def nested_offset(t):
    return load(CustomerOrders, t).nested("orders", Nested().limit(2).offset(2)).frame().select(F.col("id").alias("customer"), F.explode("orders").alias("o")).select("customer", "o.id")


@query("SELECT o_custkey AS customer, o_orderkey AS id, r - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r <= 2")
def nested_filter_order(t):
    args = Nested().filter(col("o_orderstatus").eq("F")).order_by("o_orderdate").limit(2)
    o = load(CustomerOrders, t).nested("orders", args).frame().select(F.col("id").alias("customer"), F.posexplode("orders").alias("place", "o"))
    return o.select("customer", "o.id", F.col("place").cast("long").alias("place"))


# Root SQL -----------------------------------------------------------------------------------------------------------

Revenue = View("Revenue", "customer", {"id": Column(BIGINT, "c_custkey"), "revenue": Column(FLOAT, computed=True), "n_orders": Column(BIGINT, computed=True)}, key="c_custkey")
RevenueOrders = View("Revenue", "customer", {**Revenue.fields, "orders": Child(Order, "o_custkey")}, key="c_custkey")
_REPORT = "SELECT o_custkey AS id, sum(o_totalprice) AS revenue, count(*) AS n_orders FROM orders WHERE o_orderdate >= CAST(:from AS timestamp_ntz) AND o_orderdate < CAST(:to AS timestamp_ntz) GROUP BY o_custkey"
_REPORT_SQL = "SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey"


def _report(view: View, t: Tables) -> Load:
    return load(view, t).sql(_REPORT).bind("from", "1995-01-01").bind("to", "1996-01-01")


@query(_REPORT_SQL)
def computed_report(t):
    return _report(Revenue, t).frame().withColumn("revenue", F.round("revenue", 2))


@query(f"SELECT id, n_orders FROM ({_REPORT_SQL}) WHERE n_orders >= 2 ORDER BY n_orders DESC, id LIMIT 30")
def report_wrapped(t):
    return _report(Revenue, t).filter(col("n_orders").ge(2)).order_by_desc("n_orders").limit(30).frame().select("id", "n_orders")


@query(f"SELECT r.id, r.n_orders, o_orderkey AS order_id FROM ({_REPORT_SQL}) r JOIN orders ON o_custkey = r.id")
def report_with_child(t):
    return _report(RevenueOrders, t).frame().select("id", "n_orders", F.explode("orders").alias("o")).select("id", "n_orders", F.col("o.id").alias("order_id"))


# Unions -------------------------------------------------------------------------------------------------------------


@query("SELECT event_id AS id, event_type AS tag, CASE WHEN event_type = 'purchase' THEN value END AS amount FROM events")
def union_lenient(t):
    return load(LenientEvent, t).frame().select("id", F.col("kind.$tag").alias("tag"), F.col("kind.Purchase.amount").alias("amount"))


@query("SELECT event_id AS id, event_type AS tag, value AS amount FROM events WHERE event_type = 'purchase'")
def union_tag(t):
    return load(Event, t).filter(col("event_type").eq("purchase")).frame().select("id", F.col("kind.$tag").alias("tag"), F.col("kind.Purchase.amount").alias("amount"))


@query("SELECT 'OtherVariantColumn' AS code, 'kind.Purchase.amount' AS path, event_id::VARCHAR AS key FROM events WHERE event_type <> 'purchase' AND event_id % 50 = 0 AND value IS NOT NULL")
def union_strict_violations(t):
    return load(Event, t).violations().select("code", "path", "key")


@query("SELECT o_orderkey AS id, o_orderstatus AS tag, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS priority FROM orders")
def union_table_per_variant(t):
    return load(StateOrder, t).frame().select("id", F.col("state.$tag").alias("tag"), F.col("state.Filled.total").alias("total"), F.col("state.Open.priority").alias("priority"))


# Recursion ----------------------------------------------------------------------------------------------------------

_TREE = "WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 4 END AS parent_id, p_name AS name FROM part)"


@query(f"{_TREE} SELECT a.id, b.id AS child, c.id AS grandchild FROM t a JOIN t b ON b.parent_id = a.id LEFT JOIN t c ON c.parent_id = b.id")
def tree_depth(t):
    r = load(tree(2), t).frame().select("id", F.explode("children").alias("b"))
    return r.select("id", F.col("b.id").alias("child"), F.explode_outer("b.children").alias("c")).select("id", "child", F.col("c.id").alias("grandchild"))


_BELOW = "r AS (SELECT id, parent_id, name, 1 AS level FROM t WHERE parent_id IN (SELECT id FROM t WHERE parent_id IS NULL) UNION ALL SELECT t.id, t.parent_id, t.name, level + 1 FROM t JOIN r ON t.parent_id = r.id)"


@query(f'{_TREE}, {_BELOW} SELECT parent_id AS "$parent", id, name FROM r')
def tree_closure(t):
    """All levels below the parts without a parent: every other part."""
    return load(tree(None), t).filter(col("parent_id").is_null()).levels("children")


@query(f'{_TREE}, {_BELOW} SELECT parent_id AS "$parent", id, name FROM r WHERE level <= 3')
def tree_closure_depth(t):
    """Three levels of the same."""
    three = View("Node", "part_tree", {"id": Column(BIGINT), "name": Column(STRING), "children": Child("self", "parent_id", depth=3, recursive=True)})
    return load(three, t).filter(col("parent_id").is_null()).levels("children")


@query(f"{_TREE} SELECT DISTINCT p.id, p.parent_id FROM t JOIN t p ON p.id = t.parent_id")
def chain_closure(t):
    """All parts above any part, by references followed to their end."""
    up = View("Node", "part_tree", {"id": Column(BIGINT), "parent": ToOne("self", "parent_id", optional=True, recursive=True)})
    return load(up, t).levels("parent").select("id", F.col("`$ref.parent`").alias("parent_id"))


@query(f"{_TREE}, n AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY id DESC) AS k FROM t) SELECT a.id, b.id AS child, c.id AS grandchild FROM t a JOIN n b ON b.parent_id = a.id AND b.k <= 2 LEFT JOIN n c ON c.parent_id = b.id AND c.k <= 2")
def tree_depth_paged(t):
    """Arguments of a recursive collection hold at every level: the last two children."""
    r = load(tree(2), t).nested("children", Nested().order_by_desc("id").limit(2)).frame().select("id", F.explode("children").alias("b"))
    return r.select("id", F.col("b.id").alias("child"), F.explode_outer("b.children").alias("c")).select("id", "child", F.col("c.id").alias("grandchild"))


@query(f"{_TREE} SELECT a.id, b.id AS one, c.id AS two, d.id AS three FROM t a LEFT JOIN t b ON b.id = a.parent_id LEFT JOIN t c ON c.id = b.parent_id LEFT JOIN t d ON d.id = c.parent_id")
def chain_up(t):
    f = load(Chain, t).frame()
    return f.select("id", F.col("parent.id").alias("one"), F.col("parent.parent.id").alias("two"), F.col("parent.parent.parent.id").alias("three"))


@query(f"{_TREE} SELECT a.id, b.id AS odd, c.id AS even FROM t a JOIN t b ON b.parent_id = a.id JOIN t c ON c.parent_id = b.id")
def mutual_recursion(t):
    r = load(Even, t).frame().select("id", F.explode("odds").alias("b"))
    return r.select("id", F.col("b.id").alias("odd"), F.explode("b.evens").alias("c")).select("id", "odd", F.col("c.id").alias("even"))


@query("WITH RECURSIVE c AS (SELECT max(p_partkey) AS k FROM part UNION SELECT k // 4 FROM c WHERE k > 0) SELECT k FROM c")
def cycle_detected(t):
    """The tree of all parts, of which the first has the last as its parent: one cycle, many branches."""
    return cycle_members(t.table("part_ring"), "id", "next_id")


# Graphs -------------------------------------------------------------------------------------------------------------


def _vertices(roots: Load) -> DataFrame:
    _, seen, _, _ = reach(roots)
    parts = [keys.select(F.lit(name).alias("view"), F.col("key").cast("long").alias("id")) for name, keys in sorted(seen.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(roots: Load) -> DataFrame:
    _, _, found, _ = reach(roots)
    out = None
    for (name, f), e in sorted(found.items()):
        part = e.select(F.lit(f"{name}.{f}").alias("edge"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'Customer' AS view, c_custkey AS id FROM customer UNION ALL SELECT 'Order', o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT DISTINCT 'Part', l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey UNION ALL SELECT DISTINCT 'Nation', c_nationkey FROM customer")
def graph_component(t):
    return _vertices(load(GraphCustomer, t))


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey) SELECT 'Customer.orders' AS edge, o_custkey AS a, id AS b FROM o UNION ALL SELECT 'Order.customer', id, o_custkey FROM o UNION ALL SELECT 'Order.parts', l_orderkey, l_partkey FROM lineitem JOIN o ON l_orderkey = o.id UNION ALL SELECT 'Customer.nation', c_custkey, c_nationkey FROM customer")
def graph_edges(t):
    return _edges(load(GraphCustomer, t))


# Order, filters -----------------------------------------------------------------------------------------------------

EventRow = View("EventRow", "event_rows", {"id": Column(BIGINT, "event_id"), "amount": Column(optional(FLOAT))}, key="event_id")


@query("WITH e AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' OR event_id % 50 = 0 THEN value END AS amount FROM events) (SELECT 'up' AS way, * FROM e ORDER BY amount ASC NULLS LAST, id LIMIT 25) UNION ALL (SELECT 'down', * FROM e ORDER BY amount DESC NULLS FIRST, id LIMIT 25)")
def order_nulls(t):
    up, down = load(EventRow, t).order_by("amount").limit(25), load(EventRow, t).order_by_desc("amount").limit(25)
    return up.frame().select(F.lit("up").alias("way"), "*").unionByName(down.frame().select(F.lit("down").alias("way"), "*"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING' AND c_custkey % 2 IN (0, 1)")
def filter_repeated(t):
    return load(Customer, t).filter(col("c_acctbal").gt(1000.0)).filter(col("c_mktsegment").eq("BUILDING")).frame().select("id")


# JSON, selections, GraphQL ------------------------------------------------------------------------------------------


@query("SELECT c_name AS name FROM customer")
def selection_pruned(t):
    return load(CustomerTree, t).select("name").frame()


@query("""SELECT '{"id":' || n_nationkey || ',"name":"' || n_name || '","region":{"id":' || r_regionkey || ',"name":"' || r_name || '"}}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""")
def json_scalars(t):
    return load(NationUp, t).frame().select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


@query("""SELECT '{"id":' || n_nationkey || ',"name":"' || n_name || '","region":{"id":' || r_regionkey || ',"name":"' || r_name || '"}}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""")
def json_load(t):
    """The same through the JSON that a load gives to Python, one nation with its region each."""
    return t.spark.createDataFrame([(json.dumps(v, separators=(",", ":")),) for v in load(NationUp, t).json()], "json string")


@query("SELECT c_custkey AS id, c_name AS name, (SELECT count(*) FROM (SELECT 1 FROM orders WHERE o_custkey = c_custkey LIMIT 2)) AS n FROM customer WHERE c_acctbal >= 9000 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def graphql_list(t):
    text = "query($min: Float = 1.0) { customers(where: {balance: {ge: $min}}, orderBy: [{balance: DESC}], limit: 10) { id ...N orders(limit: 2) { id } } } fragment N on Customer { name }"
    found = GraphApi(t).list("customers", CustomerOrders).execute(text, {"min": 9000.0})["customers"]
    return t.spark.createDataFrame([(c["id"], c["name"], len(c["orders"])) for c in found], "id long, name string, n long")


# Streams ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def stream_equals_all(t):
    s = load(CustomerOrders, t).filter(col("c_mktsegment").eq("BUILDING") & col("c_acctbal").gt(5000.0)).order_by_desc("c_acctbal").batch_size(100).stream()
    return t.spark.createDataFrame([(c.id, len(c.orders)) for c in s], "id long, n long")


@query("SELECT n_nationkey AS id, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation")
def json_stream_equals_all(t):
    view = View("Nation", "nation", {"id": Column(INT, "n_nationkey"), "suppliers": Child(Supplier, "s_nationkey")}, key="n_nationkey")
    return t.spark.createDataFrame([(n["id"], len(n["suppliers"])) for n in load(view, t).batch_size(7).json_stream()], "id int, n long")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def micro_batches(t):
    """Events as a stream of files, each micro-batch aggregated and appended to a table."""
    folder = f"{shared_folder(t.spark)}/micro-{uuid.uuid4().hex}"
    schema = t.table("events").schema
    t.table("events").write.parquet(f"{folder}/in")
    source = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    each_micro_batch(source, lambda b: b.groupBy("event_type").count(), lambda df, n: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/check").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.sum("count").alias("count"))


# Overrides ----------------------------------------------------------------------------------------------------------

_OVERRIDE = 'SELECT o_custkey AS `$parent`, o_orderkey AS id, o_totalprice AS total, o_orderstatus AS status, o_orderdate AS date FROM orders WHERE o_custkey IN (:keys) AND {}'


@query("SELECT o_custkey AS customer, o_orderkey AS id FROM orders WHERE o_totalprice > 1000")
def override_child(t):
    """override_child without its cut of ids: the override's rows of every customer."""
    r = Registry.builder().register(CustomerOrders).overrides("Customer", f'[query.orders]\nsql = "{_OVERRIDE.format("o_totalprice > 1000")}"').build(t)
    return r.load(CustomerOrders).frame().select(F.col("id").alias("customer"), F.explode("orders").alias("o")).select("customer", "o.id")


@query("SELECT 1::BIGINT AS runs, 1::BIGINT AS mismatches")
def shadow_mismatch(t):
    r = Registry.builder().register(CustomerOrders).overrides("Customer", f'[query.orders]\nshadow = true\nsql = "{_OVERRIDE.format("o_orderstatus <> chr(80)")}"').build(t)
    r.load(CustomerOrders).frame()
    s = r.shadow_stats(CustomerOrders, "orders")
    return t.spark.createDataFrame([(s.runs, s.mismatches)], "runs long, mismatches long")


@query("SELECT unnest(['column nation.extra is not in the snapshot', 'table region is only in the snapshot']) AS difference")
def schema_diff(t):
    old = snapshot(t, ["nation", "region"])
    new = snapshot(t.with_tables(nation=t.table("nation").withColumn("extra", F.lit(1))), ["nation"])
    return t.spark.createDataFrame([(d,) for d in old.differences(new)], "difference string")


# Writes -------------------------------------------------------------------------------------------------------------

WNation = View("Nation", "nation", {"id": Column(INT, "n_nationkey"), "name": Column(STRING, "n_name")}, key="n_nationkey")
WRegion = View("Region", "region", {"id": Column(INT, "r_regionkey"), "name": Column(STRING, "r_name"), "nations": Child(WNation, "n_regionkey")}, key="r_regionkey")


def _store(t: Tables, **more: DataFrame) -> Store:
    s = Store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    s.create(region=t.table("region"), nation=t.table("nation"), **more)
    return s


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT -1, 'more', NULL")
def merge_upsert(t):
    old = t.table("customer")
    new = old.where("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("c_name")).unionByName(t.spark.sql("SELECT -1L AS c_custkey, 'more' AS c_name"))
    return merge(old, new, ["c_custkey"]).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 5 THEN 'renamed' ELSE n_name END AS name, n_regionkey AS region FROM nation WHERE n_nationkey <> 10 UNION ALL SELECT 99, 'added', 0")
def diff_changes(t):
    import copy

    s = _store(t)
    before = Load(WRegion, s.latest()).by_key(0).one()
    after = copy.deepcopy(before)
    for n in after["nations"]:
        n["name"] = "renamed" if n["id"] == 5 else n["name"]
    after["nations"] = [n for n in after["nations"] if n["id"] != 10] + [{"id": 99, "name": "added"}]
    s.save_changes(WRegion, before, after)
    return s.latest().table("nation").selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS region")


@query("SELECT 'region' AS name, count(*) AS n FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey <> 2")
def delete_cascade(t):
    s = _store(t)
    s.delete(WRegion, 2)
    now = s.latest()
    return now.table("region").agg(F.count("*").alias("n")).select(F.lit("region").alias("name"), "n").unionByName(now.table("nation").agg(F.count("*").alias("n")).select(F.lit("nation").alias("name"), "n"))


@query("SELECT 'Conflict' AS error, 2::BIGINT AS version")
def version_conflict(t):
    from .errors import Conflict

    v = View("Doc", "doc", {"id": Column(BIGINT), "body": Column(STRING), "version": Column(BIGINT, version=True)})
    s = _store(t, doc=t.spark.createDataFrame([(1, "a", 1)], "id long, body string, version long"))
    s.save(v, {"id": 1, "body": "b", "version": 1})
    error = ""
    try:
        s.save(v, {"id": 1, "body": "c", "version": 1})
    except Conflict as e:
        error = type(e).__name__
    return s.latest().table("doc").select(F.lit(error).alias("error"), "version")


@query("SELECT r_regionkey AS region, n_nationkey AS id, upper(n_name) || '!' AS name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def save_all_frames(t):
    """A load's frame, changed on the executors, saved as a whole: odd nations go, even ones are renamed."""
    s = _store(t)
    f = load(WRegion, t).frame()
    kept = F.filter("nations", lambda n: n["id"] % 2 == 0)
    f = f.withColumn("nations", F.transform(kept, lambda n: F.struct(n["id"].alias("id"), F.concat(F.upper(n["name"]), F.lit("!")).alias("name"))))
    save_frame(s, WRegion, f)
    return s.latest().table("nation").selectExpr("n_regionkey AS region", "n_nationkey AS id", "n_name AS name")


@query("SELECT 1::BIGINT AS id, 'x' AS title UNION ALL SELECT 2, 'y' UNION ALL SELECT 8, 'z' UNION ALL SELECT 7, 'old'")
def generated_keys(t):
    v = View("Task", "task", {"id": Column(optional(BIGINT), generated=True), "title": Column(STRING)})
    s = _store(t, task=t.spark.createDataFrame([(7, "old")], "id long, title string"))
    s.save_all(v, [{"id": 1, "title": "x"}, {"id": 2, "title": "y"}, {"id": None, "title": "z"}])
    return s.latest().table("task")


# Headline -----------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)
SELECT o_orderkey AS id, o_totalprice AS total, c_name AS customer, n_name AS nation, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS dearest
FROM o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def dearest_orders(t):
    """The 20 dearest orders of one market segment, each with its customer's chain of references and its lines in order."""
    keys = t.table("orders").join(t.table("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    f = load(OrderUp, t).by_keys(keys).order_by_desc("o_totalprice").limit(20).frame()
    return f.select("id", "total", F.col("customer.name").alias("customer"), F.col("customer.nation.name").alias("nation"), F.size("lines").cast("long").alias("lines"), F.get(F.col("lines"), F.lit(0))["price"].alias("dearest"))


@query("SELECT o_orderkey AS id, count(l_orderkey) AS lines, max(l_extendedprice) AS dearest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nested_load(t):
    f = load(OrderLines, t).frame()
    return f.select("id", F.size("lines").cast("long").alias("lines"), F.get(F.col("lines"), F.lit(0))["price"].alias("dearest"))


__all__ = ["ORACLE_SQL", "QUERIES", "tables"]
