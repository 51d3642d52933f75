"""Loads, errors, graphs, overrides, checks, streams and writes on small tables."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from shapeframe import manifest as manifests
from shapeframe.cli import main
from shapeframe.errors import (
    ColumnNotSelected,
    Conflict,
    Cycle,
    DecodeError,
    DuplicateMapKey,
    GraphRequired,
    Invalid,
    KeysRequired,
    ListIndex,
    MissingReference,
    MissingVariant,
    MixedKeys,
    NestedArguments,
    NotFound,
    NotRegistered,
    NullTag,
    OtherVariantColumn,
    ParamsError,
    SelectionWithoutJson,
    TooManyRows,
    UnknownTag,
    WriteError,
)
from shapeframe.functions import Nested, col
from shapeframe.gql import GraphApi
from shapeframe.operators.graph import Graph, Ref
from shapeframe.operators.load import Load
from shapeframe.plans.sqltext import render
from shapeframe.registry import Registry, scaffold
from shapeframe.shapes import BIGINT, FLOAT, INT, JSON, STRING, Child, Column, Embed, Embedded, Sum, ToOne, Variant, View, optional
from shapeframe.sources import Tables
from shapeframe.sources.schema import Snapshot, snapshot
from shapeframe.sources.store import Store, save_frame

Person = View("Person", "person", {"id": Column(BIGINT), "name": Column(STRING)})
Note = View("Note", "note", {"id": Column(BIGINT), "body": Column(STRING)})
Tag = View("Tag", "tag", {"id": Column(STRING), "label": Column(STRING)})
Task = View(
    "Task",
    "task",
    {"id": Column(BIGINT), "name": Column(STRING), "rank": Column(optional(INT)), "owner": ToOne(Person, "owner_id", optional=True, shared=True), "notes": Child(Note, "task_id"), "tags": Child(Tag, "task_id", through="task_tag", target="tag_id", index="seq"), "by_body": Child(Note, "task_id", key="body")},
)


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    return Tables(
        spark,
        {
            "person": make([(1, "ann"), (2, "bob")], "id long, name string"),
            "task": make([(1, "a", 3, 1), (2, "b", None, None), (3, "c", 1, 2), (4, "d", 2, 1)], "id long, name string, rank int, owner_id long"),
            "note": make([(10, 1, "x"), (11, 1, "y"), (12, 3, "z"), (13, 1, "w")], "id long, task_id long, body string"),
            "tag": make([("p", "P"), ("q", "Q")], "id string, label string"),
            "task_tag": make([(1, "q", 5), (1, "p", 2), (1, "q", 9), (3, "p", 0)], "task_id long, tag_id string, seq int"),
            "node": make([(0, None), (1, 0), (2, 0), (3, 1), (4, 3)], "id long, parent_id long"),
            "ring": make([(1, 3), (2, 1), (3, 2)], "id long, parent_id long"),
        },
    )


def test_nested_values(t):
    a = Load(Task, t).order_by("id").all()
    assert [x.name for x in a] == ["a", "b", "c", "d"]
    assert [n.id for n in a[0].notes] == [10, 11, 13] and a[1].notes == []
    assert [x.id for x in a[0].tags] == ["p", "q", "q"]
    assert list(a[0].by_body) == ["x", "y", "w"] and a[1].by_body == {}
    assert a[1].owner is None and a[0].owner is a[3].owner
    assert Load(Task, t).order_by("id").limit(1).json()[0]["by_body"]["x"] == {"id": 10, "body": "x"}


def test_null_order_is_last_upwards_and_first_downwards(t):
    assert [x.id for x in Load(Task, t).order_by("rank").all()] == [3, 4, 1, 2]
    assert [x.id for x in Load(Task, t).order_by_desc("rank").all()] == [2, 1, 4, 3]


def test_terminals(t):
    assert Load(Task, t).by_key(3).one().name == "c"
    assert Load(Task, t).by_key(99).optional() is None
    with pytest.raises(NotFound):
        Load(Task, t).by_key(99).one()
    with pytest.raises(TooManyRows) as e:
        Load(Task, t).one()
    assert e.value.count == 4
    with pytest.raises(MixedKeys):
        Load(Task, t).by_keys([1, "a"])
    assert Load(Task, t).by_keys([]).all() == []
    assert Load(Task, t).filter(col("rank").not_in([])).limit(1).count() == 4
    with pytest.raises(SelectionWithoutJson):
        Load(Task, t).select("name").all()
    assert Load(Task, t).select("name owner { name }").by_key(1).json() == [{"name": "a", "owner": {"name": "ann"}}]


def test_nested_arguments_equal_trimmed_lists(t):
    whole = {x.id: [n.id for n in x.notes] for x in Load(Task, t).all()}
    for limit, offset in ((1, 0), (2, 1), (5, 2)):
        paged = {x.id: [n.id for n in x.notes] for x in Load(Task, t).nested("notes", Nested().limit(limit).offset(offset)).all()}
        assert paged == {k: v[offset : offset + limit] for k, v in whole.items()}
    for path in ("nothing", "owner"):
        with pytest.raises(NestedArguments):
            Load(Task, t).nested(path, Nested().limit(1)).all()


def test_decode_and_references(t, spark):
    broken = t.with_tables(task=spark.createDataFrame([(1, None, 7)], "id long, name string, owner_id long"))
    strict = View("Task", "task", {"id": Column(BIGINT), "name": Column(STRING)})
    with pytest.raises(DecodeError):
        Load(strict, broken).all()
    loose = View("Task", "task", {"id": Column(BIGINT), "owner": ToOne(Person, "owner_id", optional=True)})
    with pytest.raises(MissingReference):
        Load(loose, broken).all()
    assert Load(loose, broken).dangling("null").one().owner is None
    assert Load(loose, broken).count() == 1
    assert [r.code for r in Load(loose, broken).violations().collect()] == ["MissingReference"]


def test_lists_and_maps_must_be_sound(t, spark):
    v = View("Task", "task", {"id": Column(BIGINT), "notes": Child(Note, "task_id", index="id")})
    bad = t.with_tables(note=spark.createDataFrame([(1, 1, "x"), (1, 1, "y")], "id long, task_id long, body string"))
    with pytest.raises(ListIndex):
        Load(v, bad).all()
    m = View("Task", "task", {"id": Column(BIGINT), "notes": Child(Note, "task_id", key="id")})
    with pytest.raises(DuplicateMapKey):
        Load(m, bad).all()


State = Sum("State", "state", (Variant("Open", {}, "open"), Variant("Blocked", {"why": Column(STRING, "why"), "0": Column(optional(INT), "since")}, "blocked")))
Issue = View("Issue", "issue", {"id": Column(BIGINT), "state": Embed(State), "data": Column(optional(JSON), json=True)})


def issues(spark, *rows):
    return Tables(spark, {"issue": spark.createDataFrame(list(rows), "id long, state string, why string, since int, data string")})


def test_unions(spark):
    a = Load(Issue, issues(spark, (1, "open", None, None, '{"x":[1]}'), (2, "blocked", "w", 3, None))).order_by("id")
    assert a.all()[1].state == {"$tag": "blocked", "$variant": "Blocked", "why": "w", "0": 3}
    assert a.json() == [{"id": 1, "state": {"__typename": "Open"}, "data": {"x": [1]}}, {"id": 2, "state": {"__typename": "Blocked", "why": "w", "_0": 3}, "data": None}]
    for error, row in ((NullTag, (1, None, None, None, None)), (UnknownTag, (1, "odd", None, None, None)), (OtherVariantColumn, (1, "open", "w", None, None)), (DecodeError, (1, "blocked", None, None, None))):
        with pytest.raises(error):
            Load(Issue, issues(spark, row)).all()


def test_variant_tables(spark):
    pay = Sum("Pay", "kind", (Variant("Card", {"last4": Column(STRING), "notes": Child(Note, "task_id")}, None, "card", "issue_id"), Variant("Cash")), table_per_variant=True)
    v = View("Bill", "bill", {"id": Column(BIGINT), "pay": Embed(pay)})
    make = spark.createDataFrame
    tables = Tables(spark, {"bill": make([(1, "Card"), (2, "Cash")], "id long, kind string"), "card": make([(1, "4242"), (2, "1111")], "issue_id long, last4 string"), "note": make([(5, 1, "n")], "id long, task_id long, body string")})
    a = Load(v, tables).order_by("id").all()
    assert a[0].pay["last4"] == "4242" and a[0].pay["notes"][0].id == 5 and a[1].pay == {"$tag": "Cash", "$variant": "Cash"}
    with pytest.raises(MissingVariant):
        Load(v, tables.with_tables(card=make([], "issue_id long, last4 string"))).all()


def node(depth=None, table="node", up=False):
    f = ToOne("self", "parent_id", optional=True, depth=depth, recursive=depth is None) if up else Child("self", "parent_id", depth=depth, recursive=depth is None)
    return View("Node", table, {"id": Column(BIGINT), "next": f})


def test_recursion(t):
    whole = Load(node(), t).by_key(0).one()
    assert Load(node(5), t).by_key(0).one() == whole
    assert [x.id for x in whole.next] == [1, 2] and whole.next[0].next[0].next[0].id == 4
    assert Load(node(1), t).by_key(0).one().next[0].next == []
    chain = Load(node(up=True), t).by_key(4).one()
    assert chain.next.next.next.id == 0 and chain.next.next.next.next is None
    assert Load(node(4, up=True), t).by_key(4).one() == chain
    both = Load(node(), t).by_keys([0, 1]).order_by("id").all()
    assert both[0].next[0] == both[1]
    with pytest.raises(Cycle):
        Load(node(table="ring"), t).by_key(1).all()
    with pytest.raises(Cycle):
        Load(node(table="ring", up=True), t).by_key(1).all()
    ring = Load(node(4, "ring", True), t).by_key(1).one()
    assert [ring.id, ring.next.id, ring.next.next.id, ring.next.next.next.id, ring.next.next.next.next.id] == [1, 3, 2, 1, 3]


def test_random_trees_against_plain_search(spark):
    r = random.Random(5)
    for _ in range(3):
        parents = {i: (r.randrange(i) if i and r.random() < 0.9 else None) for i in range(25)}
        tables = Tables(spark, {"node": spark.createDataFrame(list(parents.items()), "id long, parent_id long")})

        def below(k, parents=parents):
            return {"id": k, "next": [below(c) for c in sorted(c for c, p in parents.items() if p == k)]}

        assert Load(node(), tables).by_key(0).one() == below(0)


Report = View("Report", "task", {"id": Column(BIGINT), "n": Column(BIGINT, computed=True), "notes": Child(Note, "task_id")})


def test_root_sql(t):
    text = "SELECT task_id AS id, count(*) AS n FROM note WHERE id >= :low GROUP BY task_id"
    load = Load(Report, t).sql(text).bind("low", 11)
    assert {x.id: (x.n, len(x.notes)) for x in load.all()} == {1: (2, 3), 3: (1, 1)}
    assert [x.id for x in load.filter(col("n").gt(1)).all()] == [1] and load.count() == 2
    with pytest.raises(ParamsError):
        Load(Report, t).sql(text).all()
    with pytest.raises(ParamsError):
        load.bind("more", 1).all()
    with pytest.raises(ParamsError):
        Load(Report, t).all()
    with pytest.raises(ColumnNotSelected):
        load.filter(col("other").eq(1)).all()
    with pytest.raises(KeysRequired):
        Load(Report, t).sql("SELECT task_id AS id, 1L AS n FROM note WHERE task_id IN (:keys)").all()


def test_stream_equals_all(t):
    load = Load(Task, t).order_by_desc("rank")
    want = load.all()
    for n in (1, 3, 1000):
        assert list(load.batch_size(n).stream()) == want
    assert list(load.limit(2).offset(1).json_stream()) == load.limit(2).offset(1).json()


def test_stream_reads_tables_a_few_times(spark, monkeypatch):
    from shapeframe.streaming import batches

    monkeypatch.setattr(batches, "FETCH", 4, raising=False)
    loads, rows = [], Load.rows
    monkeypatch.setattr(Load, "rows", lambda self, *a: loads.append(1) or rows(self, *a))
    item = View("Item", "item", {"id": Column(BIGINT), "up": Column(BIGINT)})
    below = View("Below", "item", {"id": Column(BIGINT), "items": Child("self", "up", recursive=True)})
    items = Tables(spark, {"item": spark.range(40).select("id", (F.col("id") % 7).alias("up")).where("id <> up")})
    some = View("Item", "item", {"id": Column(BIGINT), "items": Child(item, "up")})
    for n in (1, 3):
        load = Load(some, items).order_by_desc("up").batch_size(n)
        want = load.all()
        loads.clear()
        assert list(load.stream()) == want and len(loads) <= 3
    assert list(Load(below, items).batch_size(20).stream()) == sorted(Load(below, items).all(), key=lambda v: v.id)
    twice = Load(item, items).sql("SELECT id, up FROM item WHERE id < 20 UNION ALL SELECT id, up FROM item WHERE id < 20").batch_size(3)
    assert [v.id for v in twice.stream()] == sorted(v.id for v in twice.all())
    assert list(Load(item, items).filter(col("id").lt(0)).stream()) == []
    holes = Tables(spark, {"item": spark.range(9).select("id", F.when(F.col("id") < 6, F.col("id")).alias("up"))})
    with pytest.raises(DecodeError):
        list(Load(item, holes).batch_size(2).stream())


Employee = View("Employee", "employee", {"id": Column(BIGINT), "name": Column(STRING), "manager": ToOne(lambda: Employee, "manager_id", optional=True, graph=True), "team": ToOne(lambda: Team, "team_id", graph=True)})
Team = View("Team", "team", {"id": Column(BIGINT), "name": Column(STRING), "members": Child(Employee, "team_id", graph=True)})


@pytest.fixture
def org(spark):
    make = spark.createDataFrame
    return Tables(spark, {"team": make([(1, "x"), (2, "y")], "id long, name string"), "employee": make([(1, "a", 2, 1), (2, "b", 1, 1), (3, "c", 1, 2)], "id long, name string, manager_id long, team_id long")})


def test_graph(org):
    with pytest.raises(GraphRequired):
        Load(Employee, org).all()
    g = Load(Employee, org).by_key(3).graph()
    assert g.count(Employee) == 3 and g.count(Team) == 2
    c = g.root_refs[0]
    assert g.follow(c, "manager").name == "a" and g.get(g.get(g.get(c)["manager"])["manager"]).name == "b"
    assert [e.id for e in g.follow(Ref("Team", 1), "members")] == [1, 2]
    j = Load(Employee, org).by_key(1).graph_json()
    assert j[0]["$id"] == "Employee:1" and j[0]["manager"]["manager"] == {"$ref": "Employee:1"}
    assert Load(Employee, org).by_key(1).select("name manager { name }").json() == [{"name": "a", "manager": {"name": "b"}}]


Reply = View("Reply", "remark", {"id": Column(BIGINT), "author": ToOne(lambda: Writer, "author_id", graph=True)})
Remark = View("Remark", "remark", {"id": Column(BIGINT), "body": Column(STRING), "author": ToOne(lambda: Writer, "author_id", optional=True, graph=True), "readers": Child(lambda: Writer, "remark_id", through="reading", target="writer_id", order_by="name desc", graph=True), "replies": Child(Reply, "parent_id")})
Writer = View("Writer", "writer", {"id": Column(BIGINT), "name": Column(STRING), "remarks": Child(Remark, "writer_id")})


def test_graph_references_of_owned_values(spark, tmp_path):
    make = spark.createDataFrame
    made = {
        "writer": make([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "id long, name string"),
        "remark": make([(10, "x", 2, 1, None), (11, "y", None, 1, None), (12, "z", 4, None, 10), (13, "v", 1, 2, None)], "id long, body string, author_id long, writer_id long, parent_id long"),
        "reading": make([(10, 3), (10, 2), (13, 3)], "remark_id long, writer_id long"),
    }
    g = Load(Writer, Tables(spark, made)).by_key(1).graph()
    assert sorted(g.entities["Writer"]) == [1, 2, 3, 4] and list(g.entities) == ["Writer"]
    x, y = g.roots()[0].remarks
    assert g.get(x.author).name == "b" and [g.get(r).name for r in x.readers] == ["c", "b"]
    assert g.get(x.replies[0].author).name == "d" and y.author is None and y.readers == []
    assert g.get(x.author).remarks[0].author == Ref("Writer", 1)
    j = Load(Writer, Tables(spark, made)).by_key(1).graph_json()[0]["remarks"][0]
    assert j["author"]["$id"] == "Writer:2" and j["author"]["remarks"][0]["author"] == {"$ref": "Writer:1"} and j["readers"][1] == {"$ref": "Writer:2"}
    s = Store(spark, str(tmp_path / "store"))
    s.create(**made)
    y.author, x.readers = g.insert(Writer, {"id": 6, "name": "f", "remarks": []}), [Ref("Writer", 4)]
    s.save_graph(g)
    assert {r.id: r.author_id for r in s.latest().table("remark").collect()} == {10: 2, 11: 6, 12: 4, 13: 1}
    assert sorted(map(tuple, s.latest().table("reading").collect())) == [(10, 4), (13, 3)]


OVER = "SELECT task_id AS `$parent`, id, body FROM note WHERE task_id IN (:keys) AND body <> 'y'"
Plain = View("Task", "task", {"id": Column(BIGINT), "name": Column(STRING), "notes": Child(Note, "task_id")})


def test_overrides_reload_and_shadow(t, tmp_path):
    f = tmp_path / "Task.sql"
    f.write_text(f"-- shapeframe: query notes\n{OVER};\n")
    r = Registry.builder().register(Plain).overrides_dir(str(tmp_path)).build(t)
    assert [n.id for n in r.load(Plain).by_key(1).one().notes] == [10, 13]
    assert [n.id for n in r.load(Plain).nested("notes", Nested().limit(1)).order_by("id").all()[0].notes] == [10]
    assert "override" in r.explain(Plain)
    assert not r.reload()
    f.write_text("-- shapeframe: query notes\nSELECT 1")
    with pytest.raises(Invalid):
        r.reload()
    assert [n.id for n in r.load(Plain).by_key(1).one().notes] == [10, 13]
    f.write_text(f"-- shapeframe: query notes, shadow\n{OVER}")
    assert r.reload()
    r.load(Plain).by_key(1).one()
    assert (r.shadow_stats(Plain, "notes").runs, r.shadow_stats(Plain, "notes").mismatches) == (1, 1)
    with pytest.raises(NotRegistered):
        r.load(Task)


@pytest.mark.parametrize(
    ("sql", "code"),
    [
        (OVER.replace("id, body", "id"), "M0102"),
        (OVER.replace("body FROM", "body AS bodi FROM"), "M0102"),
        (OVER.replace("id, body", "id, body, body"), "M0102"),
        (OVER.replace("id, body", "id, 1 AS body"), "M0102"),
        (OVER.replace("id, body", "id, body, 1 AS more"), "M0102"),
        (OVER.replace("task_id AS", "CAST(task_id AS STRING) AS"), "M0102"),
        (OVER.replace("FROM note", "FROM missing"), "M0103"),
        (OVER.replace("SELECT", "SELEKT"), "M0103"),
        (OVER.replace("IN (:keys)", "> 0"), "M0104"),
        (OVER + " AND id > :low", "M0104"),
    ],
)
def test_broken_overrides_are_found(t, sql, code):
    b = Registry.builder().register(Plain).overrides("Task", f'[query.notes]\nsql = """{sql}"""')
    assert code in b.check(t).codes()
    with pytest.raises(Invalid):
        b.build(t)
    assert [n.id for n in b.on_invalid("use_generated").build(t).load(Plain).by_key(1).one().notes] == [10, 11, 13]


def test_names_of_overrides(t):
    assert "M0101" in Registry.builder().register(Plain).overrides("Tusk", "").check(t).codes()
    assert "did you mean `notes`" in str(Registry.builder().register(Plain).overrides("Task", '[query.nots]\nsql = "SELECT 1"').check(t))
    assert "M0100" in Registry.builder().register(Plain).overrides("Task", "[query").check(t).codes()
    assert Registry.builder().register(Task).check(t).ok()


def test_generated_sql_gives_the_plan_s_rows(t, spark):
    q = Load(Task, t).plan()
    keys = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "key long")
    for name in ("notes", "tags"):
        x = q.find(name)
        by_sql = t.sql(render(x), None, keys).select(*[f"`{c.alias}`" for c in x.columns])
        by_plan = Load(Task, t).flat(name).select(*[f"`{c.alias}`" for c in x.columns])
        assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, by_plan.collect()))
    tree = Load(node(), t).plan().find("next")
    by_sql = t.sql(render(tree), None, spark.createDataFrame([(0,)], "key long")).select("`$parent`", "id")
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, Load(node(), t).by_key(0).levels("next").select("`$parent`", "id").collect()))


def test_manifest_snapshot_and_command_line(t, spark, tmp_path, capsys):
    m = manifests.build([Task])
    assert manifests.Manifest.from_json(m.to_json()) == m
    path, schema = tmp_path / "views.json", tmp_path / "schema.json"
    assert m.write(str(path)) and not m.write(str(path))
    declared = {n: {"primary_key": ["id"], "not_null": ["id", "name", "body", "label"]} for n in ("task", "note", "tag", "person")}
    s = snapshot(t, ["task", "note", "tag", "person", "task_tag"], declared)
    schema.write_text(s.to_json())
    assert Snapshot.from_json(s.to_json()) == s and m.check_snapshot(s).codes() == []
    worse = copy.deepcopy(s)
    worse.table("note").columns = [c for c in worse.table("note").columns if c.name != "body"]
    worse.table("task").column("name").type = "int"
    worse.table("tag").column("id").type = "bigint"
    worse.table("person").primary_key = []
    assert {"M0202", "M0203", "M0205", "M0206"} <= set(m.check_snapshot(worse).codes())
    worse.tables = [x for x in worse.tables if x.name != "person"]
    assert "M0201" in m.check_snapshot(worse).codes()
    assert len(s.differences(worse)) == 4
    assert main(["check", "--manifest", str(path), "--snapshot", str(schema)]) == 0
    schema.write_text(worse.to_json())
    assert main(["check", "--manifest", str(path), "--snapshot", str(schema)]) == 1
    assert main(["explain", "--manifest", str(path), "Task"]) == 0
    assert main(["scaffold", "--manifest", str(path), "Task", "--query", "notes", "--out", str(tmp_path)]) == 0
    assert main(["scaffold", "--manifest", str(path), "Task", "--query", "notes", "--out", str(tmp_path)]) == 2
    assert main(["nothing"]) == 2
    assert manifests.ci(str(path), str(schema), [str(tmp_path)]).codes()
    assert "[query.\"notes\"]" in scaffold(Task, queries=["notes"])
    for name in ("task", "note"):
        t.table(name).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = tmp_path / "now.json"
    args = ["schema", "--tables", str(tmp_path), "--table", "task", "--table", "note"]
    assert main([*args, "--out", str(out)], spark) == 0 and main([*args, "--check", str(out)], spark) == 0
    assert json.loads(out.read_text())["backend"] == "Spark"


def test_graphql(t):
    api = GraphApi(t).list("tasks", Task).by_key("task", Task)
    got = api.execute('{ tasks(where: {name: {in: ["a", "c"]}}, orderBy: [{id: DESC}]) { n: name notes(limit: 1) { body } by_body { key value { id } } } task(key: 2) { owner { name } } }')
    assert got["tasks"][1] == {"n": "a", "notes": [{"body": "x"}], "by_body": [{"key": "x", "value": {"id": 10}}, {"key": "y", "value": {"id": 11}}, {"key": "w", "value": {"id": 13}}]}
    assert got["task"] == {"owner": None}
    for bad in ("{ tasks { notes(limit: 1) { id } notes(limit: 2) { id } } }", "{ nothing { id } }", "mutation { x }", "{ tasks(where: {name: {near: 1}}) { id } }"):
        with pytest.raises(Exception, match="."):
            api.execute(bad)
    sdl = api.sdl()
    assert "type Task {" in sdl and "tasks(where: TaskWhere" in sdl and "notes(where: NoteWhere" in sdl


# Writes -------------------------------------------------------------------------------------------------------------

Card = View("Card", "card", {"id": Column(optional(BIGINT), generated=True), "title": Column(STRING)})
Lane = View("Lane", "lane", {"id": Column(BIGINT), "name": Column(STRING), "cards": Child(Card, "lane_id")})
Label = View("Label", "label", {"id": Column(BIGINT)})
Kind = Sum("Kind", "kind", (Variant("Plain"), Variant("Priced", {"price": Column(FLOAT)}, None, "priced", "board_id")), table_per_variant=True)
Board = View("Board", "board", {"id": Column(BIGINT), "name": Column(STRING), "version": Column(BIGINT, version=True), "kind": Embed(Kind), "lanes": Child(Lane, "board_id", index="position"), "labels": Child(Label, "board_id", through="board_label", target="label_id")})


@pytest.fixture
def store(spark, tmp_path):
    s, make = Store(spark, str(tmp_path / "store")), lambda x: spark.createDataFrame([], x)
    s.create(
        board=make("id long, name string, version long, kind string, other string"),
        priced=make("board_id long, price double"),
        lane=make("id long, board_id long, name string, position int"),
        card=make("id long, lane_id long, title string"),
        label=spark.createDataFrame([(1,), (2,)], "id long"),
        board_label=make("board_id long, label_id long"),
    )
    return s


def board():
    return {"id": 1, "name": "b", "version": 0, "kind": {"$tag": "Priced", "price": 2.5}, "lanes": [{"id": 10, "name": "x", "cards": [{"id": None, "title": "c"}, {"id": None, "title": "d"}]}, {"id": 11, "name": "y", "cards": []}], "labels": [{"id": 2}, {"id": 1}]}


def counts(s):
    now = s.latest()
    return {n: now.table(n).count() for n in now.names()}


def test_save_and_changes(store):
    saved = store.save(Board, board())
    assert saved.version == 1 and [c.id for c in saved.lanes[0].cards] == [1, 2]
    got = Load(Board, store.latest()).one()
    assert got.kind["price"] == 2.5 and [x.name for x in got.lanes] == ["x", "y"]
    pinned = store.latest()
    after = copy.deepcopy(got)
    after["lanes"] = [after["lanes"][1], after["lanes"][0]]
    after["lanes"][1]["cards"].pop()
    after["kind"] = {"$tag": "Plain"}
    after["labels"] = after["labels"][:1]
    store.save_changes(Board, got, after)
    assert counts(store) == {"board": 1, "priced": 0, "lane": 2, "card": 1, "label": 2, "board_label": 1}
    assert [x.name for x in Load(Board, store.latest()).one().lanes] == ["y", "x"]
    assert Load(Board, pinned).one() == got
    version = store.version()
    same = Load(Board, store.latest()).one()
    store.save_changes(Board, same, copy.deepcopy(same))
    assert store.version() == version
    with pytest.raises(Conflict):
        store.save_changes(Board, got, dict(copy.deepcopy(got), name="late"))
    with pytest.raises(WriteError):
        store.save_changes(Board, got, dict(copy.deepcopy(got), id=2))
    assert store.delete(Board, 1) and not store.delete(Board, 1)
    assert counts(store) == {"board": 0, "priced": 0, "lane": 0, "card": 0, "label": 2, "board_label": 0}


def test_two_writers(store):
    base = store.version()
    store.commit({"label": store.latest().table("label")}, base)
    with pytest.raises(Conflict):
        store.commit({"label": store.latest().table("label")}, base)


def test_save_graph(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.create(team=spark.createDataFrame([], "id long, name string"), employee=spark.createDataFrame([(9, "old", None, 1)], "id long, name string, manager_id long, team_id long"))
    g = Graph(Employee)
    team = g.insert(Team, {"id": 1, "name": "t", "members": []})
    a = g.insert(Employee, {"id": 1, "name": "a", "manager": None, "team": team})
    b = g.insert(Employee, {"id": 2, "name": "b", "manager": a, "team": team})
    g.get_mut(a)["manager"] = b
    with pytest.raises(WriteError):
        s.save_graph(g)
    g.get_mut(team)["members"] = [a, b]
    g.add_root(a)
    s.save_graph(g)
    assert not g.is_changed(a)
    rows = {r.id: (r.name, r.manager_id, r.team_id) for r in s.latest().table("employee").collect()}
    assert rows[1] == ("a", 2, 1) and rows[2] == ("b", 1, 1)
    g.get_mut(a)["name"] = "z"
    g.get(b)["name"] = "not written"
    s.save_graph_changes(g)
    rows = {r.id: r.name for r in s.latest().table("employee").collect()}
    assert rows[1] == "z" and rows[2] == "b"


def test_save_frame_of_embedded_values_and_maps(spark, tmp_path):
    size = Embedded("Size", {"wide": Column(BIGINT), "unit": Embed(Embedded("Unit", {"name": Column(STRING, "unit")}), "u_")})
    part = View("Part", "part", {"id": Column(BIGINT), "name": Column(STRING), "size": Embed(size, "s_")})
    box = View("Box", "box", {"id": Column(BIGINT), "size": Embed(size), "parts": Child(part, "box_id", key="slot"), "list": Child(part, "box_id")})
    s = Store(spark, str(tmp_path / "store"))
    s.create(
        box=spark.createDataFrame([(1, 5, "cm"), (2, 6, "cm")], "id long, wide long, u_unit string"),
        part=spark.createDataFrame([(10, "a", 1, "mm", 1, "x"), (11, "b", 2, "mm", 1, "y"), (12, "c", 3, "mm", 2, "x")], "id long, name string, s_wide long, s_u_unit string, box_id long, slot string"),
    )
    f = Load(View("Box", "box", {k: v for k, v in box.fields.items() if k != "list"}), s.latest()).frame()
    grown = F.transform_values(F.map_filter("parts", lambda k, v: v["id"] != 10), lambda k, v: v.withField("size", v["size"].withField("wide", v["size"]["wide"] + 10)))
    added = F.create_map(F.lit("z"), F.get("list", F.lit(0)))
    other = f.where("id = 2").select(F.array(F.struct(F.lit(13).cast("long").alias("id"), F.lit("n").alias("name"), "size")).alias("list"))
    f = f.crossJoin(other).select("id", F.col("size").withField("wide", F.lit(7)).withField("unit", F.struct(F.lit("m").alias("name"))).alias("size"), F.when(F.col("id") == 2, F.map_concat(grown, added)).otherwise(grown).alias("parts"))
    save_frame(s, box, f)
    assert sorted(map(tuple, s.latest().table("box").collect())) == [(1, 7, "m"), (2, 7, "m")]
    rows = sorted(map(tuple, s.latest().table("part").collect()))
    assert rows == [(11, "b", 12, "mm", 1, "y"), (12, "c", 13, "mm", 2, "x"), (13, "n", 6, "cm", 2, "z")]


def test_save_frame_keeps_what_another_collection_holds(spark, tmp_path):
    v = View("Box", "box", {"id": Column(BIGINT), "all": Child(Note, "task_id"), "named": Child(Note, "task_id", key="body")})
    s = Store(spark, str(tmp_path / "store"))
    s.create(box=spark.createDataFrame([(1,)], "id long"), note=spark.createDataFrame([(10, 1, "x"), (11, 1, "y"), (12, 1, "z")], "id long, task_id long, body string"))
    f = Load(v, s.latest()).frame().withColumn("named", F.map_filter("named", lambda k, n: k == "x")).withColumn("all", F.filter("all", lambda n: n["id"] != 12))
    save_frame(s, v, f)
    assert sorted(r.id for r in s.latest().table("note").collect()) == [10, 11]


def test_save_frame_refuses_what_it_does_not_write(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.create(issue=spark.createDataFrame([(1, "a")], "id long, tag string"))
    v = View("Issue", "issue", {"id": Column(BIGINT), "state": Embed(Sum("State", "tag", (Variant("A", tag_value="a"),)))})
    with pytest.raises(WriteError):
        save_frame(s, v, Load(v, s.latest()).frame())
    wrong = View("Issue", "issue", {"id": Column(BIGINT), "more": Column(STRING)})
    with pytest.raises(WriteError):
        save_frame(s, wrong, spark.createDataFrame([(1, "x")], "id long, more string"))
    assert s.version() == 1


def test_closure_plan_does_not_grow(spark):
    """A chain of 40 levels: each level's plan is the same, and a depth ends it."""
    table = spark.range(41).selectExpr("CASE WHEN id >= 0 THEN id END AS id", "CASE WHEN id = 0 THEN NULL ELSE id - 1 END AS parent_id")
    for depth, rows in ((None, 40), (3, 3)):
        view = View("Node", "chain", {"id": Column(BIGINT), "below": Child("self", "parent_id", depth=depth, recursive=True)})
        load = Load(view, Tables(spark, {"chain": table})).by_key(0)
        levels = load.levels("below")
        assert levels.count() == rows and len(levels._jdf.queryExecution().optimizedPlan().toString()) < 5000
        value, deep = load.one(), 0
        while value.below:
            value, deep = value.below[0], deep + 1
        assert deep == rows
    every = Load(view, Tables(spark, {"chain": table})).all()
    assert [len(every[0].below), len(every[0].below[0].below[0].below), every[0].below[0].below[0].below[0].below] == [1, 1, []]


def test_user_sql_in_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    spark.range(3).createOrReplaceTempView("thing")
    t = Tables(spark, {"thing": spark.range(100).withColumnRenamed("id", "k")})

    def one(i):
        keys = spark.createDataFrame([(i,)], "key long")
        return [r.k for r in t.sql("SELECT k FROM thing WHERE k IN (:keys)", keys=keys).collect()]

    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(one, range(24))) == [[i] for i in range(24)]
    assert spark.table("thing").count() == 3
    spark.catalog.dropTempView("thing")


def test_unknown_columns(t):
    with pytest.raises(ColumnNotSelected):
        Load(Task, t).filter(col("nowhere").eq(1)).frame()
    with pytest.raises(ColumnNotSelected):
        Load(Task, t).order_by("nowhere").frame()
