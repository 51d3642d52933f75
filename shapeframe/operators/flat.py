"""The flat form: one DataFrame for each query of a plan, columns named by their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ColumnNotSelected
from ..functions.filters import Nested
from ..plans.plan import Query, Selected
from ..plans.sqltext import quote


def column(name: str) -> Column:
    return F.col(quote(name))


def ordered(c: Column, descending: bool) -> Column:
    """NULLs last upwards and first downwards."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def aliased(c: Selected, own: DataFrame, link: DataFrame | None) -> Column:
    source = (link if c.side == "link" else own)[quote(c.column)]
    return (source.cast("string") if c.role == "tag" else source).alias(c.alias)


def resolver(q: Query):
    """From a column of the view's table to the column that the query selects for it; else the alias itself, for computed fields."""

    def resolve(name: str) -> Column:
        alias = q.alias_of(name) or next((c.alias for c in q.columns if c.role == "computed" and c.alias == name), None)
        if alias is None:
            raise ColumnNotSelected(q.view.name, name, "the query is overridden and doesn't select the column")
        return column(alias)

    return resolve


def own_column(view: str, table: DataFrame):
    """From a name to the table's column."""
    names = {c.lower() for c in table.columns}

    def resolve(name: str) -> Column:
        if name.lower() not in names:
            raise ColumnNotSelected(view, name, "its table has no such column")
        return table[quote(name)]

    return resolve


def generated(q: Query, table: DataFrame, link: DataFrame | None, keys: DataFrame | None, args: Nested | None) -> DataFrame:
    """The rows of a query that isn't the root, with ``$row`` if they are paged or ordered by the arguments.

    keys is a frame of one column ``key`` (distinct, not null) if the rows above are restricted.
    """
    field = q.link.field if q.link.kind == "child" else None
    if link is not None:
        rows = table.join(link, table[quote(q.key_column)] == link[quote(field.target)])
        parent = link[quote(q.link.fk)]
    else:
        rows = table
        parent = table[quote(q.link.fk if field else q.key_column)]
    if args and args.condition is not None:
        rows = rows.where(args.condition.to_column(own_column(q.view.name, table)))
    columns = [aliased(c, table, link) for c in q.columns if c.role != "computed"]
    columns += [F.lit(None).cast("string").alias(c.alias) for c in q.columns if c.role == "computed"]
    if field:
        rows = rows.where(parent.isNotNull())
    terms = order_terms(q, args)
    if field and terms is not None:
        window = Window.partitionBy(parent).orderBy(*[ordered(own_column(q.view.name, table)(c), d) for c, d in terms])
        columns.append(F.row_number().over(window).alias("$row"))
    if keys is not None:
        k = keys.select(F.col("key").alias("shapeframe_parent_key"))
        rows = rows.join(k, parent == F.col("shapeframe_parent_key"), "left_semi")
    return paged(rows.select(*columns), args)


def order_terms(q: Query, args: Nested | None) -> list[tuple[str, bool]] | None:
    """Terms for a row number; None where sorting by ascending values will do, without a window."""
    declared = q.order()
    if args and args.order:
        declared = args.order if any(c == q.key_column for c, _ in args.order) else [*args.order, (q.key_column, False)]
    needs = any(d for _, d in declared) or (args and (args.order or args.limit_ is not None or args.offset_))
    return declared if needs or any(q.alias_of(c) is None for c, _ in declared) else None


def paged(rows: DataFrame, args: Nested | None) -> DataFrame:
    if args and (args.limit_ is not None or args.offset_):
        rows = rows.where(column("$row") <= args.offset_ + args.limit_) if args.limit_ is not None else rows
        rows = rows.where(column("$row") > args.offset_) if args.offset_ else rows
    return rows


def wrapped(q: Query, rows: DataFrame, args: Nested | None) -> DataFrame:
    """Arguments over an override's rows; columns are then the aliases it selects."""
    if q.link.kind != "child":
        return rows
    resolve = resolver(q)
    if args and args.condition is not None:
        rows = rows.where(args.condition.to_column(resolve))
    if "$row" not in rows.columns and args and (args.order or args.limit_ is not None or args.offset_):
        terms = [*args.order, (q.key_column, False)] if args.order else q.order()
        window = Window.partitionBy(column("$parent")).orderBy(*[ordered(resolve(c), d) for c, d in terms])
        rows = rows.withColumn("$row", F.row_number().over(window))
    elif "$row" not in rows.columns and order_terms(q, None) is not None:
        window = Window.partitionBy(column("$parent")).orderBy(*[ordered(resolve(c), d) for c, d in q.order()])
        rows = rows.withColumn("$row", F.row_number().over(window))
    return paged(rows, args)
