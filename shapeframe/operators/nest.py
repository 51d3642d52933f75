"""The nested form: one row for each root, with structs, arrays and maps.

Each collection is aggregated to one row per parent before it is joined, so two collections never multiply; a reference
is joined by its key. Everything is one lazy plan: Catalyst picks the joins, and drops those whose field isn't selected.
Data errors are guards in the plan (``raise``), rows of a frame of violations (``collect``), or left alone (``off``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NestedArguments
from ..functions.filters import Nested
from ..plans.plan import Query, Repeat
from ..shapes import Child, Embed, Embedded, Field, Sum, ToOne
from ..shapes import Column as ColumnField
from .flat import column, generated, wrapped
from .recurse import closure

VALUE = "$value"


@dataclass
class Context:
    """What a load runs with: rows by query, arguments by query name, and how errors are told."""

    tables: Any
    nested: dict[str, Nested] = field(default_factory=dict)
    validate: str = "raise"
    dangling: str = "raise"
    override: Callable[[Query, DataFrame | None], DataFrame | None] = lambda q, keys: None
    violations: list[DataFrame] = field(default_factory=list)
    closures: dict[str, DataFrame] = field(default_factory=dict)
    flats: dict[str, DataFrame] = field(default_factory=dict)
    edges: Callable[[Query, Child, DataFrame], DataFrame] | None = None  # of a graph load: (a, b, place) of a graph collection of owned values


Rule = tuple[str, str, Column, Column]  # code, path, condition, detail


def query_rows(q: Query, ctx: Context, keys: DataFrame | None) -> DataFrame:
    """The flat rows of a child, reference or variant query."""
    args = ctx.nested.get(q.name)
    own = ctx.override(q, keys)
    if own is not None:
        rows = wrapped(q, own, args)
        if q.link.kind == "child" and "$parent" in rows.columns:
            rows = rows.where(column("$parent").isNotNull())
    else:
        link = ctx.tables.table(q.link.field.through) if q.link.kind == "child" and q.link.field.through else None
        rows = generated(q, ctx.tables.table(q.table), link, keys, args)
    ctx.flats.setdefault(q.name, rows)
    return rows


def nest(q: Query, rows: DataFrame, ctx: Context, restricted: bool, left: dict[int, int] | None = None) -> DataFrame:
    """rows with a column ``$value``, the struct of the query's fields; system columns stay."""
    left = left or {}
    key = column(q.key_alias)
    rules: list[Rule] = []
    parts: dict[str, Column] = {}
    for path, child in q.children.items():
        at = _field(q.fields, path)
        if child is None:
            continue
        target = child
        budget = left
        if isinstance(child, Repeat):
            target = child.query
            remaining = left.get(id(target), child.depth - 1)
            if remaining <= 0:
                parts[path] = F.array().cast("array<string>") if isinstance(at, Child) else F.lit(None).cast("string")
                continue
            budget = left | {id(target): remaining - 1}
        elif isinstance(at, (Child, ToOne)) and at.depth:
            budget = left | {id(target): at.depth - 1}
        if target.link.kind == "child":
            rows = _collection(q, rows, path, target, at, ctx, restricted, budget, parts, rules)
        elif target.link.kind == "to_one":
            rows = _reference(q, rows, path, target, at, ctx, restricted, budget, parts, rules)
        else:
            rows = _variant(q, rows, path, target, ctx, restricted, budget, parts, rules)
    if ctx.edges and q.link.kind != "root":
        rows = _graph_keys(q, rows, ctx, parts)
    value = _struct(q, q.fields, "", parts, rules, rows)
    if rules and ctx.validate == "collect":
        for code, path, bad, detail in rules:
            ctx.violations.append(rows.where(bad).select(F.lit(code).alias("code"), F.lit(q.owner).alias("view"), F.lit(path).alias("path"), key.cast("string").alias("key"), detail.alias("detail")))
    elif rules and ctx.validate == "raise":
        text = F.coalesce(*[F.when(bad, F.concat(F.lit(f"shapeframe|{code}|{q.owner}|{path}|"), F.coalesce(detail, F.lit("")), F.lit("|end|"))) for code, path, bad, detail in rules])
        any_bad = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, _, bad, _ in rules])
        value = F.when(~any_bad, value).otherwise(F.raise_error(text))
    return rows.withColumn(VALUE, value)


def _field(fields: dict[str, Field], path: str) -> Field | None:
    return fields.get(path)


def _keys(rows: DataFrame, name: str, restricted: bool, only: Column | None = None) -> DataFrame | None:
    if not restricted:
        return None
    rows = rows.where(only) if only is not None else rows
    return rows.select(column(name).alias("key")).where("key IS NOT NULL").distinct()


def _graph_keys(q: Query, rows: DataFrame, ctx: Context, parts: dict[str, Column]) -> DataFrame:
    """The keys of the entities that owned values reference."""
    for f, x in q.fields.items():
        if not isinstance(x, (Child, ToOne)) or not x.graph or f in q.children:
            continue
        if isinstance(x, ToOne):
            parts[f] = column(f"$ref.{f}")
            continue
        e = ctx.edges(q, x, rows.select(column(q.key_alias).alias("key")).distinct())
        owner, name = f"$owner_of.{f}", f"$keys.{f}"
        lists = e.groupBy(F.col("a").alias(owner)).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "b"))), lambda s: s["b"]).alias(name))
        rows = rows.join(lists, column(q.key_alias) == column(owner), "left").drop(owner)
        parts[f] = F.coalesce(column(name), F.array().cast(lists.schema[name].dataType))
    return rows


def _collection(q, rows, path, target, at, ctx, restricted, budget, parts, rules) -> DataFrame:
    keys = _keys(rows, q.key_alias, restricted or target.closure)
    if target.closure:
        if target.name in ctx.nested:
            raise NestedArguments(q.view.name, target.name, "a collection of all levels takes no arguments")
        flat = closure(target, ctx.tables.table(target.table), keys)
        ctx.closures[target.name] = nest(target, flat, ctx, True, budget)
        return rows
    child = nest(target, query_rows(target, ctx, keys), ctx, restricted, budget)
    name = f"$list.{path}"
    aggregated = collect(target, child, at).withColumnRenamed("$items", name)
    parent = f"$parent_of.{path}"
    aggregated = aggregated.withColumnRenamed("$parent", parent)
    rows = rows.join(aggregated, column(q.key_alias) == column(parent), "left").drop(parent)
    empty = F.create_map().cast(aggregated.schema[name].dataType) if at.key else F.array().cast(aggregated.schema[name].dataType)
    parts[path] = F.coalesce(column(name), empty)
    if at.index:
        flag = f"$bad.{path}"
        rows = rows.withColumnRenamed("$bad", flag)
        rules.append(("ListIndex", path, column(flag), F.lit("an index is NULL or repeated")))
    return rows


def collect(target: Query, child: DataFrame, at: Child) -> DataFrame:
    """(``$parent``, ``$items``, and for lists by index ``$bad``): one row per parent."""
    value = column(VALUE)
    if at.key:
        entry = F.struct(column("$map_key").alias("k"), value.alias("v"))
        return child.groupBy(column("$parent")).agg(F.map_from_entries(F.collect_list(entry)).alias("$items"))
    if at.index:
        order = [column("$index").alias("p0")]
    elif "$row" in child.columns:
        order = [column("$row").alias("p0")]
    else:
        order = []
        for i, (c, _) in enumerate(target.order()):
            alias = target.alias_of(c)
            declared = next((x.type for x in target.columns if x.alias == alias), None)
            if declared is None or declared.nullable:
                order.append(column(alias).isNull().alias(f"n{i}"))
            order.append(column(alias).alias(f"p{i}"))
    kind = child.schema[VALUE].dataType
    if not at.index and "$row" not in child.columns and _comparable(kind) and _leads(target, kind):
        return child.groupBy(column("$parent")).agg(F.sort_array(F.collect_list(value)).alias("$items"))
    struct = F.struct(*order, value.alias("v"))
    items = F.collect_list(struct)
    # Sorting structs compares the value only after equal orders; a map can't be compared, so it is left out of the struct.
    if not _comparable(kind):
        names = [f"x.{n}" for n in child.select(struct.alias("s")).schema["s"].dataType.names if n != "v"]
        less = " ".join(f"WHEN {n} < {n.replace('x.', 'y.', 1)} THEN -1 WHEN {n} > {n.replace('x.', 'y.', 1)} THEN 1" for n in names)
        grouped = child.groupBy(column("$parent")).agg(items.alias("$all"))
        out = grouped.select("$parent", F.expr(f"transform(array_sort(`$all`, (x, y) -> CASE {less} ELSE 0 END), z -> z.v)").alias("$items"), "$all")
    else:
        out = child.groupBy(column("$parent")).agg(F.sort_array(items).alias("$all"))
        out = out.select("$parent", F.transform(column("$all"), lambda z: z["v"]).alias("$items"), "$all")
    if at.index:
        indexes = F.transform(column("$all"), lambda z: z["p0"])
        bad = (F.size(F.array_distinct(indexes)) < F.size(indexes)) | F.exists(indexes, lambda i: i.isNull())
        return out.select("$parent", "$items", bad.alias("$bad"))
    return out.drop("$all")


def _leads(target: Query, kind: T.StructType) -> bool:
    """Whether the values' own first fields are their order, so that they sort as they are."""
    terms = target.order()
    aliases = [target.alias_of(c) for c, _ in terms]
    known = {c.alias: c.type for c in target.columns if c.type is not None and not c.type.nullable}
    return not any(d for _, d in terms) and all(a in known for a in aliases) and kind.names[: len(terms)] == aliases


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return False
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    return not isinstance(kind, T.StructType) or all(_comparable(f.dataType) for f in kind.fields)


def _reference(q, rows, path, target, at, ctx, restricted, budget, parts, rules) -> DataFrame:
    ref = f"$ref.{path}"
    keys = _keys(rows, ref, restricted or target.closure)
    if target.closure:
        flat = closure(target, ctx.tables.table(target.table), keys)
        ctx.closures[target.name] = nest(target, flat, ctx, True, budget)
        return rows
    one = nest(target, query_rows(target, ctx, keys), ctx, restricted, budget)
    key, name = f"$key_of.{path}", f"$one.{path}"
    rows = rows.join(one.select(column(target.key_alias).alias(key), column(VALUE).alias(name)), column(ref) == column(key), "left")
    parts[path] = column(name)
    missing = column(ref).isNotNull() & column(key).isNull()
    if ctx.dangling == "raise":
        rules.append(("MissingReference", path, missing if at.optional else missing | column(ref).isNull(), F.lit("its row was not found")))
    return rows


def _variant(q, rows, path, target, ctx, restricted, budget, parts, rules) -> DataFrame:
    is_it = column(target.link.alias) == target.link.tag
    keys = _keys(rows, q.key_alias, restricted, is_it)
    one = nest(target, query_rows(target, ctx, keys), ctx, restricted, budget)
    key, name = f"$key_of.{path}", f"$one.{path}"
    rows = rows.join(one.select(column(target.key_alias).alias(key), column(VALUE).alias(name)), (column(q.key_alias) == column(key)) & is_it, "left")
    parts[path] = column(name)
    rules.append(("MissingVariant", path, is_it & column(key).isNull(), F.lit("its row was not found")))
    return rows


def _struct(q: Query, fields: dict[str, Field], at: str, parts: dict[str, Column], rules: list[Rule], rows: DataFrame, inside: Column | None = None) -> Column:
    """The struct of some fields; inside tells when they are expected, for fields that aren't optional."""
    have = {c.alias for c in q.columns if c.role in ("field", "computed", "tag")}
    out = []
    for f, x in fields.items():
        path = at + f
        if isinstance(x, ColumnField) and path in have:
            if path in rows.columns:
                out.append(column(path).alias(f))
                if not x.type.nullable and not x.generated and not x.computed:
                    missing = column(path).isNull()
                    rules.append(("DecodeError", path, missing if inside is None else inside & missing, F.lit("NULL in a field that isn't optional")))
            else:
                out.append(F.lit(None).cast("string").alias(f))
        elif isinstance(x, Embed) and isinstance(x.shape, Embedded) and any(a.startswith(f"{path}.") for a in have):
            out.append(_struct(q, x.shape.fields, f"{path}.", parts, rules, rows, inside).alias(f))
        elif isinstance(x, Embed) and f"{path}.$tag" in have:
            out.append(_union(q, x.shape, path, parts, rules, rows, inside).alias(f))
        elif path in parts:
            out.append(parts[path].alias(f))
    return F.struct(*out) if out else F.struct(column(q.key_alias).alias("$key"))


def _union(q: Query, shape: Sum, at: str, parts: dict[str, Column], rules: list[Rule], rows: DataFrame, inside: Column | None) -> Column:
    tag = column(f"{at}.$tag")
    expected = F.lit(True) if inside is None else inside
    names = [v.tag for v in shape.variants]
    rules.append(("NullTag", f"{at}.$tag", expected & tag.isNull(), F.lit("the tag is NULL")))
    rules.append(("UnknownTag", f"{at}.$tag", expected & tag.isNotNull() & ~tag.isin(*names), F.concat(F.lit("the tag is "), tag, F.lit(f", not one of {', '.join(names)}"))))
    out = [tag.alias("$tag")]
    excluded = next(s.excluded for s in q.sums if s.path == at)
    for v in shape.variants:
        is_it = expected & (tag == v.tag)
        for a in excluded[v.name]:
            if a in rows.columns:
                rules.append(("OtherVariantColumn", a, is_it & column(a).isNotNull(), F.concat(F.lit("belongs to another variant than "), tag)))
        if f"{at}.{v.name}" in parts:
            out.append(parts[f"{at}.{v.name}"].alias(v.name))
        elif v.fields:
            out.append(F.when(tag == v.tag, _struct(q, v.fields, f"{at}.{v.name}.", parts, rules, rows, is_it)).alias(v.name))
    return F.struct(*out)
