"""From a view to its tree of flat queries: one for the root, one for each relationship.

A query's columns are aliased by their paths within its view; system aliases start with ``$``: ``$key`` (where no field
holds the key), ``$parent``, ``$index``, ``$map_key``, ``$ref.<field>`` and ``<path>.$tag``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import PlanError
from ..functions.selection import Selection
from ..shapes import Child, Column, Embed, Embedded, Field, Sum, ToOne, ValueType, Variant, View, order_terms


@dataclass(frozen=True)
class Selected:
    """A column of a query. ``side`` is own or link; ``role`` tells system columns from fields."""

    alias: str
    column: str
    type: ValueType | None = None
    side: str = "own"
    role: str = "field"
    inner: bool = False  # inside an embedded value or union: may be NULL where the row holds none


@dataclass(frozen=True)
class SumPlan:
    """A union of the query's row: where its tag is, and which columns each variant excludes."""

    path: str
    shape: Sum
    excluded: dict[str, tuple[str, ...]]


@dataclass(frozen=True)
class Link:
    kind: str  # root, child, to_one, variant
    fk: str = ""
    field: Child | ToOne | None = None
    alias: str = ""  # $ref.<field> or <path>.$tag of the parent query
    tag: str = ""

    def describe(self) -> str:
        if self.kind == "child":
            return f" (to-many through {self.field.through}.{self.fk})" if self.field.through else f" (to-many by {self.fk})"
        if self.kind == "to_one":
            return f" (to-one by {self.alias})"
        return f" (variant where {self.alias} = '{self.tag}')" if self.kind == "variant" else ""


@dataclass
class Repeat:
    """The query of a level above runs again, for as many levels in all as the depth."""

    query: Query
    up: int
    depth: int


@dataclass
class Query:
    name: str
    view: View
    owner: str  # view or variant that the rows are decoded as
    fields: dict[str, Field]
    table: str
    key_column: str
    key_alias: str
    link: Link
    columns: list[Selected] = field(default_factory=list)
    sums: list[SumPlan] = field(default_factory=list)
    children: dict[str, Query | Repeat | None] = field(default_factory=dict)  # by path; None: in the rows of this query
    closure: bool = False
    whole: bool = True  # no selection took fields away
    chosen: Selection | None = None

    def walk(self) -> list[Query]:
        """The distinct queries, parents first."""
        return [self, *(q for c in self.children.values() if isinstance(c, Query) for q in c.walk())]

    def find(self, name: str) -> Query | None:
        return next((q for q in self.walk() if q.name == name), None)

    def query_count(self) -> int:
        return len(self.walk())

    def alias_of(self, column: str) -> str | None:
        """The alias under which the query selects a column of its table."""
        return next((c.alias for c in self.columns if c.side == "own" and c.column == column and c.role in ("field", "key")), None) or (self.key_alias if column == self.key_column else None)

    def order(self) -> list[tuple[str, bool]]:
        """Declared order of a collection: its terms, then the key."""
        terms = order_terms(self.link.field.order_by) if self.link.kind == "child" else []
        return terms if any(c == self.key_column for c, _ in terms) else [*terms, (self.key_column, False)]


def plan(view: View, selection: Selection | None = None) -> Query:
    return _query(view, view.name, view.fields, view.table, view.key, "$root", Link("root"), [], selection)


def selected(fields: dict[str, Field], selection: Selection | None, where: str) -> dict[str, Selection | None]:
    """The fields to load, with the selections inside them."""
    if selection is None:
        return dict.fromkeys(fields)
    names = [n for n in selection.fields() if n != "__typename"]
    if not names:
        return {f: None for f, x in fields.items() if isinstance(x, (Column, Embed))}
    for n in names:
        if n not in fields:
            raise PlanError(where, n, f"{n} is not a field here")
        if isinstance(fields[n], Column) and not selection.get(n).is_empty():
            raise PlanError(where, n, "a column has no fields")
    return {f: None if isinstance(x, (Column, Embed)) else selection.get(f) for f, x in fields.items() if f in names}


def _query(view: View, owner: str, fields: dict[str, Field], table: str, key: str, name: str, link: Link, stack: list[tuple[str, str, Query]], selection: Selection | None) -> Query:
    own_key = next((f for f, x in fields.items() if isinstance(x, Column) and not x.computed and (x.column or f) == key), None)
    q = Query(name, view, owner, fields, table, key, own_key or "$key", link, whole=selection is None, chosen=selection)
    if isinstance(link.field, Child):
        side = "link" if link.field.through else "own"
        q.columns.append(Selected("$parent", link.fk, None, side, "parent"))
        if link.field.index:
            q.columns.append(Selected("$index", link.field.index, None, side, "index"))
        if link.field.key:
            q.columns.append(Selected("$map_key", link.field.key, None, side, "map_key"))
    chosen = selected(fields, selection, view.name)
    if own_key is None or own_key not in chosen:
        q.columns.append(Selected(q.key_alias, key, None, "own", "key"))
    _add(q, fields, chosen, "", "", stack, False)
    return q


def _add(q: Query, fields: dict[str, Field], chosen: dict[str, Selection | None], path: str, prefix: str, stack: list[tuple[str, str, Query]], inner: bool) -> None:
    for f, inside in chosen.items():
        x, at = fields[f], path + f
        if isinstance(x, Column):
            role = "computed" if x.computed else "field"
            q.columns.append(Selected(at, prefix + (x.column or f), x.type, "own", role, inner))
        elif isinstance(x, Embed) and isinstance(x.shape, Embedded):
            _add(q, x.shape.fields, dict.fromkeys(x.shape.fields), f"{at}.", prefix + x.prefix, stack, True)
        elif isinstance(x, Embed):
            _add_sum(q, x.shape, at, prefix + x.prefix, stack, inner)
        else:
            _add_relation(q, f, x, at, inside, stack)


def _add_sum(q: Query, shape: Sum, at: str, prefix: str, stack: list[tuple[str, str, Query]], inner: bool) -> None:
    q.columns.append(Selected(f"{at}.$tag", prefix + shape.tag, None, "own", "tag", inner))
    own: dict[str, dict[str, str]] = {}
    for v in shape.variants:
        before = len(q.columns)
        if shape.table_per_variant and v.fields:
            if inner:
                raise PlanError(q.view.name, at, "a union in tables of its variants cannot be inside an embedded value")
            link = Link("variant", fk=v.key, alias=f"{at}.$tag", tag=v.tag)
            name = f"{at}.{v.name}" if q.name == "$root" else f"{q.name}.{at}.{v.name}"
            q.children[f"{at}.{v.name}"] = _query(q.view, f"{shape.name}::{v.name}", v.fields, v.table, v.key, name, link, stack, None)
        else:
            _add(q, v.fields, dict.fromkeys(v.fields), f"{at}.{v.name}.", prefix, stack, True)
        own[v.name] = {c.alias: c.column for c in q.columns[before:] if c.side == "own"}
    if not shape.table_per_variant:
        excluded = {}
        for v in shape.variants:
            mine = set(own[v.name].values())
            excluded[v.name] = tuple(a for other in shape.variants if other is not v for a, c in own[other.name].items() if c not in mine) if not shape.lenient else ()
        q.sums.append(SumPlan(at, shape, excluded))
    else:
        q.sums.append(SumPlan(at, shape, {v.name: () for v in shape.variants}))


def _add_relation(q: Query, f: str, x: ToOne | Child, at: str, inside: Selection | None, stack: list[tuple[str, str, Query]]) -> None:
    if isinstance(x, ToOne):
        q.columns.append(Selected(f"$ref.{at}", x.fk, None, "own", "ref"))
    if x.graph and inside is None:
        return  # graph edges are followed by the graph load
    target = q.view.target(x)
    link = Link("to_one", fk=x.fk, field=x, alias=f"$ref.{at}") if isinstance(x, ToOne) else Link("child", fk=x.fk, field=x)
    name = at if q.name == "$root" else f"{q.name}.{at}"
    if inside is not None or q.chosen is not None:
        q.children[at] = _query(target, target.name, target.fields, target.table, target.key, name, link, stack, inside or Selection())
        return
    here = (q.owner, at)
    above = next((i for i, (o, p, _) in enumerate(stack) if (o, p) == here), None)
    if above is not None:
        loop = [s[2].link.field for s in stack[above + 1 :]] + [x]
        if any(y.recursive for y in loop if y):
            if len(loop) > 1 or target is not q.view:
                raise PlanError(q.view.name, at, "recursion without a depth goes from a view directly to itself")
            q.children[at] = None
            return
        depth = next((y.depth for y in loop if y is not None and y.depth), None)
        if depth is None:
            raise PlanError(q.view.name, at, f"{target.name} contains itself; give the field a depth")
        q.children[at] = Repeat(stack[above][2], len(stack) - 1 - above, depth)
        return
    if target is q.view and not (x.depth or x.recursive):
        raise PlanError(q.view.name, at, f"{target.name} contains itself; give the field a depth")
    if x.recursive and target is not q.view:
        raise PlanError(q.view.name, at, "recursion without a depth goes from a view directly to itself")
    child = Query(name, target, target.name, target.fields, target.table, target.key, "", link)
    built = _query(target, target.name, target.fields, target.table, target.key, name, link, [*stack, (*here, child)], None)
    child.__dict__.update(built.__dict__)
    child.closure = x.recursive
    q.children[at] = child


def variant_of(q: Query, path: str) -> Variant | None:
    return next((v for s in q.sums for v in s.shape.variants if f"{s.path}.{v.name}" == path), None)
