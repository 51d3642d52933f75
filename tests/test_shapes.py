import pytest

from shapeframe.errors import PlanError, ShapeError
from shapeframe.functions import Condition, Selection, col
from shapeframe.plans import plan
from shapeframe.plans.sqltext import explain, parameters, with_keys
from shapeframe.shapes import BIGINT, INT, STRING, Child, Column, Embed, Embedded, Sum, ToOne, Variant, View, generic, optional

Item = View("Item", "item", {"id": Column(BIGINT), "name": Column(STRING)})


def view(**fields):
    return View("V", "v", {"id": Column(BIGINT), **fields})


@pytest.mark.parametrize(
    "make",
    [
        lambda: view(x=Child(Item, "")),
        lambda: view(x=Child(Item, "f", through="l")),
        lambda: view(x=Child(Item, "f", target="t")),
        lambda: view(x=Child(Item, "f", index="i", key="k")),
        lambda: view(x=Child(Item, "f", key="k", graph=True)),
        lambda: view(x=Child(Item, "f", graph=True, depth=1)),
        lambda: view(x=Child(Item, "f", depth=0)),
        lambda: view(x=Child(Item, "f", order_by="a up")),
        lambda: view(x=Child("self", "f", recursive=True, through="l", target="t")),
        lambda: view(x=ToOne("self", "f", depth=2)),
        lambda: view(x=ToOne("self", "f", optional=True, depth=2, recursive=True)),
        lambda: view(x=Column(STRING, version=True)),
        lambda: view(x=Column(optional(BIGINT), generated=True)),
        lambda: View("V", "v", {"id": Column(BIGINT, generated=True)}),
        lambda: view(x=Column(BIGINT, "c", computed=True)),
        lambda: View("V", "", {}),
        lambda: Embedded("E", {"x": Child(Item, "f")}),
        lambda: Embedded("E", {"x": Column(INT, computed=True)}),
        lambda: Sum("S", "", ()),
        lambda: Sum("S", "t", (Variant("A"), Variant("B", tag_value="A"))),
        lambda: Sum("S", "t", (Variant("A", {"x": Child(Item, "f")}),)),
        lambda: Sum("S", "t", (Variant("A", {"0": Column(INT)}),)),
        lambda: Sum("S", "t", (Variant("A", table="a"),)),
        lambda: Sum("S", "t", (Variant("A", {"x": Column(INT)}),), table_per_variant=True),
    ],
)
def test_declarations_that_no_view_can_have(make):
    with pytest.raises(ShapeError):
        make()


def test_aliases_and_names():
    union = Sum("State", "state", (Variant("Open"), Variant("Blocked", {"why": Column(STRING, "why"), "since": Column(STRING)})))
    v = View("Task", "task", {"key": Column(BIGINT, "id"), "address": Embed(Embedded("A", {"city": Column(STRING)}), "addr_"), "state": Embed(union), "owner": ToOne(Item, "owner_id"), "notes": Child(Item, "task_id", index="n")})
    q = plan(v)
    assert [c.alias for c in q.columns] == ["key", "address.city", "state.$tag", "state.Blocked.why", "state.Blocked.since", "$ref.owner"]
    assert q.columns[1].column == "addr_city"
    assert [x.name for x in q.walk()] == ["$root", "owner", "notes"]
    assert [c.alias for c in q.find("notes").columns] == ["$parent", "$index", "id", "name"]
    assert q.sums[0].excluded["Open"] == ("state.Blocked.why", "state.Blocked.since")


def test_recursion_needs_a_depth():
    with pytest.raises(PlanError):
        plan(view(x=Child("self", "f")))
    a = View("A", "a", {"id": Column(BIGINT), "b": Child(lambda: b, "f")})
    b = View("B", "b", {"id": Column(BIGINT), "a": Child(lambda: a, "f")})
    with pytest.raises(PlanError):
        plan(a)
    text = explain(plan(view(x=Child("self", "f", depth=3))))
    assert "unrolled from the query 0 above, to depth 3" in text
    assert "rows of every level, found by the closure above" in explain(plan(view(x=Child("self", "f", recursive=True))))


def test_selection():
    s = Selection.parse("{ name, assignee { name } children { name children { name } } }")
    assert str(s) == "name assignee { name } children { name children { name } }"
    for bad in ("a {", "a }", "{ a { b }", "a ! b"):
        with pytest.raises(PlanError):
            Selection.parse(bad)
    v = view(name=Column(STRING), children=Child("self", "f", recursive=True))
    q = plan(v, Selection.parse("name children { children { id } }"))
    assert [x.name for x in q.walk()] == ["$root", "children", "children.children"]
    with pytest.raises(PlanError):
        plan(v, Selection.parse("nothing"))
    with pytest.raises(PlanError):
        plan(v, Selection.parse("name { x }"))


def test_conditions():
    c = (col("a").eq(1) & col("b").lt(2)) & ~(col("c").is_in([]) | col("d").like("x%"))
    assert c.columns() == {"a", "b", "c", "d"}
    assert len(c.parts) == 3
    assert Condition.all([]).to_sql(str) == "TRUE" and Condition.any([]).to_sql(str) == "FALSE"


def test_parameters_outside_literals():
    names, keys = parameters("SELECT ':no', `:no`, x::int /* :no */ FROM t WHERE a = :one AND b IN (:keys) -- :no\n AND c = :one AND :two > 1")
    assert names == ["one", "two"] and keys
    assert with_keys("x = ANY(:keys) AND y IN ($1) AND z = ':keys'") == "x IN (SELECT `key` FROM shapeframe_keys) AND y IN (SELECT `key` FROM shapeframe_keys) AND z = ':keys'"


def test_generic_shapes():
    span = generic("Range", lambda t: {"start": Column(t), "end": Column(t)})
    assert span(INT) is span(INT) and span(INT).name == "Range<Int>" and span(STRING).name == "Range<String>"
