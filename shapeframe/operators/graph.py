"""Graphs: every entity that the roots reach, once, with typed references between them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnloadedReference
from ..lineage import cut
from ..plans.plan import Query
from ..plans.sqltext import quote
from ..shapes import Child, Column, Embed, Embedded, Field, Sum, ToOne, View, relations
from .decode import Decoder, Record, scalar, to_json
from .flat import column, ordered
from .nest import VALUE, nest


@dataclass(frozen=True)
class Ref:
    """A reference into a graph: which view, and which of its entities."""

    view: str
    key: Any


@dataclass
class Graph:
    """Entities by view and key, the roots, and what was changed since loading or saving."""

    root_view: View
    views: dict[str, View] = field(default_factory=dict)
    entities: dict[str, dict[Any, Record]] = field(default_factory=dict)
    root_refs: list[Ref] = field(default_factory=list)
    changed: set[Ref] = field(default_factory=set)

    def insert(self, view: View, value: dict[str, Any]) -> Ref:
        """Adds an entity; one whose key the database will give is known by a stand-in until it is saved."""
        self.views[view.name] = view
        arena = self.entities.setdefault(view.name, {})
        key = value.get(view.key_field)
        ref = Ref(view.name, key if key is not None else f"new:{len(arena)}")
        arena[ref.key] = Record(value)
        self.changed.add(ref)
        return ref

    def add_root(self, ref: Ref) -> None:
        self.root_refs.append(ref)

    def get(self, ref: Ref) -> Record:
        try:
            return self.entities[ref.view][ref.key]
        except KeyError as e:
            raise UnloadedReference(ref.view, "", "a reference points to an entity that was not loaded") from e

    def get_mut(self, ref: Ref) -> Record:
        self.changed.add(ref)
        return self.get(ref)

    def follow(self, ref: Ref, name: str) -> Any:
        """The entity, or entities, that a field references."""
        got = self.get(ref)[name]
        return None if got is None else self.get(got) if isinstance(got, Ref) else [self.get(r) for r in got]

    def all(self, view: View) -> list[Record]:
        return list(self.entities.get(view.name, {}).values())

    def count(self, view: View) -> int:
        return len(self.entities.get(view.name, {}))

    def is_changed(self, ref: Ref) -> bool:
        return ref in self.changed

    def roots(self) -> list[Record]:
        return [self.get(r) for r in self.root_refs]


def edges_of(view: View) -> dict[str, ToOne | Child]:
    """Graph references of an entity: its own fields' (values it owns may hold more: see inner_keys)."""
    return {f: x for f, x in view.fields.items() if isinstance(x, (ToOne, Child)) and x.graph}


def reach(load: Any) -> tuple[DataFrame, dict[str, DataFrame], dict[tuple[str, str], DataFrame], dict[str, View]]:
    """(root keys, vertex keys by view, edges (a, b, place) by view and field, views), all distributed.

    Rounds of a breadth-first search: the frontier's edges are found by semi joins, what was seen before drops out by an
    anti join, and each round is materialised. An entity is expanded once, so cycles end.
    """
    view, tables = load.view, load.tables
    roots = cut(load.key_frame())
    views, seen, found = {view.name: view}, {}, {}
    frontier = {view.name: roots.select(F.col("key")).distinct()}
    while frontier:
        following: dict[str, list[DataFrame]] = {}
        for name, keys in frontier.items():
            keys = cut(keys if name not in seen else keys.join(seen[name], "key", "left_anti"))
            if not keys.limit(1).count():
                continue
            seen[name] = keys if name not in seen else cut(seen[name].unionByName(keys))
            for f, x in edges_of(views[name]).items():
                target = views[name].target(x)
                views[target.name] = target
                e = cut(edge_rows(tables, views[name], x, keys))
                found[(name, f)] = e if (name, f) not in found else found[(name, f)].unionByName(e)
                following.setdefault(target.name, []).append(e.select(F.col("b").alias("key")))
            for target, inner in inner_keys(load, views[name], keys):
                views[target.name] = target
                following.setdefault(target.name, []).append(cut(inner))
        frontier = {}
        for name, parts in following.items():
            union = parts[0]
            for p in parts[1:]:
                union = union.unionByName(p)
            frontier[name] = union.where("key IS NOT NULL").distinct()
    return roots, seen, found, views


def entities(load: Any, view: View, keys: DataFrame) -> tuple[Query, DataFrame, Any]:
    """The nested rows of the entities with the keys; values that they own hold the keys of what they reference."""
    one = type(load)(view, load.tables, load.overrides).by_keys(keys)
    one.dangling_ = load.dangling_
    q: Query = one.plan()
    ctx = one.context("raise")
    ctx.edges = lambda owned, x, k: edge_rows(load.tables, owned.view, x, k)
    return q, nest(q, one.root(q), ctx, True), ctx


def inner_keys(load: Any, view: View, keys: DataFrame) -> list[tuple[View, DataFrame]]:
    """(view, keys) of what the values owned by the entities with the keys reference."""
    if not any(x.graph for q in type(load)(view, load.tables).plan().walk()[1:] for x in relations(q.fields)):
        return []
    q, rows, ctx = entities(load, view, keys)
    out: list[tuple[View, DataFrame]] = []

    def walk(owner: View, fields: dict[str, Field], values: DataFrame, root: bool) -> None:
        kind = values.schema["v"].dataType
        if not isinstance(kind, T.StructType):
            return
        for f, x in fields.items():
            if f not in kind.names:
                continue
            at = F.col(f"v.{quote(f)}")
            if isinstance(x, Embed) and isinstance(x.shape, Sum):
                for v in x.shape.variants:
                    if v.name in kind[f].dataType.names:
                        walk(owner, v.fields, values.select(F.col(f"v.{quote(f)}.{quote(v.name)}").alias("v")), False)
            elif isinstance(x, (ToOne, Child)) and not (x.graph and root):
                many = isinstance(x, Child)
                got = values.select((F.explode(F.map_values(at) if x.key else at) if many else at).alias("v")).where("v IS NOT NULL")
                target = owner.target(x)
                if x.graph:
                    out.append((target, got.select(F.col("v").alias("key"))))
                else:
                    walk(target, target.fields, got, False)

    walk(view, view.fields, rows.select(F.col(f"`{VALUE}`").alias("v")), True)
    for name, level in ctx.closures.items():
        inner = q.find(name).view
        walk(inner, inner.fields, level.select(F.col(f"`{VALUE}`").alias("v")), False)
    return out


def edge_rows(tables: Any, view: View, x: ToOne | Child, keys: DataFrame) -> DataFrame:
    """(a, b, place): from the entities with the keys to those they reference; place orders a collection."""
    k = keys.select(F.col("key").alias("_key"))
    if isinstance(x, ToOne):
        t = tables.table(view.table)
        rows = t.join(k, t[quote(view.key)] == F.col("_key"), "left_semi").where(t[quote(x.fk)].isNotNull())
        return rows.select(t[quote(view.key)].alias("a"), t[quote(x.fk)].alias("b"), F.lit(1).alias("place"))
    target = view.target(x)
    t = tables.table(target.table)
    rows, parent, index = t, t[quote(x.fk)] if not x.through else None, t[quote(x.index)] if x.index and not x.through else None
    if x.through:
        link = tables.table(x.through)
        rows, parent = t.join(link, t[quote(target.key)] == link[quote(x.target)]), link[quote(x.fk)]
        index = link[quote(x.index)] if x.index else None
    from pyspark.sql import Window

    from ..shapes import order_terms

    terms = [ordered(index, False)] if index is not None else [ordered(t[quote(c)], d) for c, d in order_terms(x.order_by)] + [ordered(t[quote(target.key)], False)]
    rows = rows.join(k, parent == F.col("_key"), "left_semi")
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*terms))
    return rows.select(parent.alias("a"), t[quote(target.key)].alias("b"), place.alias("place"))


def load_graph(load: Any) -> Graph:
    """Vertices and edges are found by distributed rounds; the graph of Python values holds what they found."""
    roots, seen, found, views = reach(load)
    graph = Graph(load.view, views)
    for name, keys in seen.items():
        view = views[name]
        q, rows, ctx = entities(load, view, keys)
        got = load._run(rows.collect)
        decoder = Decoder({n: load._run(df.collect) for n, df in ctx.closures.items()}, Ref)
        graph.entities[name] = {r[q.key_alias]: decoder.value(q, r[VALUE], r) for r in got}
        for f, x in edges_of(view).items():
            for e in graph.entities[name].values():
                e[f] = None if isinstance(x, ToOne) else []
    for (name, f), e in found.items():
        x, target = views[name].fields[f], views[name].target(views[name].fields[f])
        for a, b, _ in load._run(e.orderBy("a", "place").collect):
            if a not in graph.entities.get(name, {}):
                continue
            if b not in graph.entities.get(target.name, {}):
                raise UnloadedReference(target.name, f, "a reference points to an entity that was not loaded")
            if isinstance(x, ToOne):
                graph.entities[name][a][f] = Ref(target.name, b)
            else:
                graph.entities[name][a][f].append(Ref(target.name, b))
    for name, values in graph.entities.items():
        edges = edges_of(views[name])
        for ref in (r for e in values.values() for f, v in e.items() if f not in edges for r in _refs(v)):
            if ref.key not in graph.entities.get(ref.view, {}):
                raise UnloadedReference(ref.view, "", "a reference points to an entity that was not loaded")
    graph.root_refs = [Ref(load.view.name, r.key) for r in load._run(roots.collect)]
    for r in graph.root_refs:
        if r.key not in graph.entities.get(load.view.name, {}):
            raise QueryError(load.view.name, "$root", f"no row with key {r.key}")
    return graph


def _refs(value: Any) -> Iterator[Ref]:
    """The references in a field of owned values."""
    if isinstance(value, Ref):
        yield value
    elif isinstance(value, (dict, list)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _refs(v)


def graph_json(graph: Graph) -> list[Any]:
    """Roots as JSON; an entity is written where it is first reached, depth first, and as ``$ref`` elsewhere."""
    written: set[Ref] = set()

    def entity(ref: Ref) -> Any:
        name = f"{ref.view}:{ref.key}"
        if ref in written:
            return {"$ref": name}
        written.add(ref)
        view, value = graph.views[ref.view], graph.get(ref)
        out = {"$id": name}
        for f, x in view.fields.items():
            if f in edges_of(view):
                got = value.get(f)
                out[f] = None if got is None else entity(got) if isinstance(got, Ref) else [entity(r) for r in got]
            else:
                out |= to_json({f: value[f]} if f in value else {}, view.fields, view.name, None, entity)
        return out

    return [entity(r) for r in graph.root_refs]


__all__ = ["Column", "Embed", "Embedded", "Graph", "Ref", "column", "graph_json", "load_graph", "reach", "scalar"]
