"""Loading: a builder for what to load, and terminals that say in which form."""

from __future__ import annotations

import copy
import logging
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphRequired, KeysRequired, MixedKeys, NestedArguments, NotFound, ParamsError, SelectionWithoutJson, TooManyRows, translated
from ..functions.filters import Condition, Nested
from ..functions.selection import Selection
from ..plans.plan import Query, plan
from ..plans.sqltext import parameters, quote
from ..shapes import Child, View
from ..sources.tables import Tables
from .decode import Decoder, Record, to_json
from .flat import aliased, column, ordered, own_column, resolver
from .nest import VALUE, Context, nest, query_rows

log = logging.getLogger("shapeframe")


class Load:
    """``Load(view, tables).filter(...).order_by(...).all()``; each step returns a changed copy."""

    def __init__(self, view: View, tables: Tables, overrides: Any = None):
        self.view, self.tables, self.overrides = view, tables, overrides
        self.keys: list[Any] | DataFrame | None = None
        self.condition: Condition | None = None
        self.order: list[tuple[str, bool]] = []
        self.limit_: int | None = None
        self.offset_ = 0
        self.selection: Selection | None = None
        self.text: str | None = None
        self.params: dict[str, Any] = {}
        self.nested_: dict[str, Nested] = {}
        self.batch = 1000
        self.dangling_ = "raise"

    def _with(self, **changed: Any) -> Load:
        out = copy.copy(self)
        out.__dict__.update(changed)
        return out

    def by_key(self, key: Any) -> Load:
        return self.by_keys([key])

    def by_keys(self, keys: Iterable[Any] | DataFrame) -> Load:
        if isinstance(keys, DataFrame):
            return self._with(keys=keys.select(F.col(keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct())
        both = [*(self.keys if isinstance(self.keys, list) else []), *keys]
        if len({"int" if isinstance(k, int) and not isinstance(k, bool) else type(k).__name__ for k in both}) > 1:
            raise MixedKeys(self.view.name, "", "keys of one load must be all integers or all strings")
        return self._with(keys=both)

    def filter(self, condition: Condition) -> Load:
        return self._with(condition=condition if self.condition is None else self.condition & condition)

    def order_by(self, name: str) -> Load:
        return self._with(order=[*self.order, (name, False)])

    def order_by_desc(self, name: str) -> Load:
        return self._with(order=[*self.order, (name, True)])

    def limit(self, n: int) -> Load:
        return self._with(limit_=n)

    def offset(self, n: int) -> Load:
        return self._with(offset_=n)

    def select(self, selection: Selection | str) -> Load:
        return self._with(selection=Selection.parse(selection) if isinstance(selection, str) else selection)

    def sql(self, text: str) -> Load:
        return self._with(text=text)

    def bind(self, name: str, value: Any) -> Load:
        return self._with(params=self.params | {name: value})

    def nested(self, path: str, args: Nested) -> Load:
        return self._with(nested_=self.nested_ | {path: args})

    def batch_size(self, n: int) -> Load:
        return self._with(batch=max(1, n))

    def dangling(self, what: str) -> Load:
        """``null`` lets references to missing rows be NULL instead of an error."""
        return self._with(dangling_=what)

    # Planning -------------------------------------------------------------------------------------------------------

    def plan(self) -> Query:
        q = plan(self.view, self.selection)
        for path in self.nested_:
            at = q.find(path)
            if at is None or at.link.kind != "child":
                raise NestedArguments(self.view.name, path, "no collection has this query")
            if at.closure:
                raise NestedArguments(self.view.name, path, "a collection of all levels takes no arguments")
        return q

    def context(self, validate: str) -> Context:
        over: Callable = (lambda q, keys: self.overrides.rows(self, q, keys)) if self.overrides else (lambda q, keys: None)
        return Context(self.tables, self.nested_, validate, self.dangling_, over)

    def _keys_frame(self) -> DataFrame | None:
        if self.keys is None or isinstance(self.keys, DataFrame):
            return self.keys
        kind = "string" if self.keys and isinstance(self.keys[0], str) else "bigint"
        return self.tables.spark.createDataFrame([(k,) for k in dict.fromkeys(self.keys)], f"key {kind}")

    def root(self, q: Query) -> DataFrame:
        """The root rows: keys, filter, order and page over the table, the load's own SQL, or an override."""
        text, shadow = self.text, None
        active = None if text else (self.overrides.root(q) if self.overrides else None)
        if active is not None:
            text, shadow = active.sql, active
        if text is None:
            if self.params:
                raise ParamsError(self.view.name, "$root", f"no parameter :{next(iter(self.params))}")
            if bad := [c.alias for c in q.columns if c.role == "computed" and not c.type.nullable]:
                raise ParamsError(self.view.name, bad[0], "a computed field needs SQL that selects it")
            table = self.tables.table(self.view.table)
            resolve = own_column(self.view.name, table)
            rows = self._restrict(q, table, resolve, table[quote(self.view.key)])
            sorts = [resolve(c).alias(f"$order.{i}") for i, (c, _) in enumerate(self.order)]
            return rows.select(*sorts, *[aliased(c, table, None) for c in q.columns if c.role != "computed"], *[F.lit(None).cast("string").alias(c.alias) for c in q.columns if c.role == "computed"])
        takes = parameters(text)[1]
        if takes and self.keys is None:
            raise KeysRequired(self.view.name, "$root", "the override takes the keys, so load by key")
        rows = self.tables.sql(text, self.params, self._keys_frame() if takes else None, self.view.name)
        if shadow is not None and shadow.shadow:
            self.overrides.compare(self, q, rows)
        resolve = resolver(q)
        rows = self._restrict(q, rows, resolve, column(q.key_alias)).withColumns({f"$order.{i}": resolve(c) for i, (c, _) in enumerate(self.order)})
        for c in q.columns:
            if c.role == "tag" and c.alias in rows.columns:
                rows = rows.withColumn(c.alias, column(c.alias).cast("string"))
        return rows

    def _restrict(self, q: Query, rows: DataFrame, resolve: Callable[[str], Column], key: Column) -> DataFrame:
        if isinstance(self.keys, list) and len(self.keys) <= 1000:
            rows = rows.where(key.isin(*self.keys) if self.keys else F.lit(False))
        elif self.keys is not None:
            k = self._keys_frame().select(F.col("key").alias("shapeframe_key"))
            rows = rows.join(k, key == F.col("shapeframe_key"), "left_semi")
        if self.condition is not None:
            rows = rows.where(self.condition.to_column(resolve))
        if self.limit_ is not None or self.offset_:  # else only the result is ordered
            rows = rows.orderBy(*[ordered(resolve(c), d) for c, d in self.order], ordered(key, False))
        if self.offset_:
            rows = rows.offset(self.offset_)
        return rows if self.limit_ is None else rows.limit(self.limit_)

    @property
    def restricted(self) -> bool:
        return self.keys is not None or self.condition is not None or self.limit_ is not None or bool(self.offset_)

    # Terminals ------------------------------------------------------------------------------------------------------

    def rows(self, validate: str = "raise") -> tuple[Query, DataFrame, Context]:
        """The plan, the nested rows with their system columns, and what came along."""
        q, ctx = self.plan(), self.context(validate)
        root = self.root(q)
        ctx.flats["$root"] = root
        return q, self._sorted(q, nest(q, root, ctx, self.restricted)), ctx

    def _sorted(self, q: Query, rows: DataFrame) -> DataFrame:
        """The order of the roots, after joins have dealt the rows anew."""
        if not (self.order or self.limit_ is not None or self.offset_):
            return rows
        return rows.orderBy(*[ordered(column(f"$order.{i}"), d) for i, (_, d) in enumerate(self.order)], ordered(column(q.key_alias), False))

    def frame(self, validate: str = "raise") -> DataFrame:
        """One row per root with nested columns. A view that reaches all levels comes without those fields; see ``levels``."""
        self._no_graph()
        q, rows, _ = self.rows(validate)
        return rows.select(f"{quote(VALUE)}.*")

    def levels(self, name: str) -> DataFrame:
        """The rows of an all-levels query, flat: its aliases, the link to the level before, each row once."""
        _, _, ctx = self.rows("off")
        return ctx.closures[name].drop(VALUE)

    def flat(self, name: str = "$root") -> DataFrame:
        """The rows of one query of the plan, by alias."""
        q = self.plan()
        target = q.find(name)
        if target is None:
            raise NestedArguments(self.view.name, name, "the plan has no such query")
        _, _, ctx = self.rows("off")
        return ctx.flats[name] if name in ctx.flats else ctx.closures[name].drop(VALUE)

    def violations(self) -> DataFrame:
        """(code, view, path, key, detail) of every row that a load would fail on."""
        _, rows, ctx = self.rows("collect")
        empty = self.tables.spark.createDataFrame([], "code string, view string, path string, key string, detail string")
        for v in ctx.violations:
            empty = empty.unionByName(v)
        return empty

    def count(self) -> int:
        """Roots that match, whatever the order and page."""
        self.tables.spark.sparkContext.setJobDescription(f"shapeframe.count {self.view.name}")
        return self._run(self.count_frame().first)[0]

    def count_frame(self) -> DataFrame:
        plain = self._with(order=[], limit_=None, offset_=0, nested_={})
        return plain.root(plan(self.view, Selection().field(self.view.key_field) if self.view.key_field and self.text is None else None)).agg(F.count("*").alias("count"))

    def key_frame(self) -> DataFrame:
        """The keys of the roots that match, filtered, ordered and paged."""
        q = plan(self.view)
        return self._sorted(q, self.root(q)).select(column(q.key_alias).alias("key"))

    def all(self) -> list[Record]:
        self._no_graph()
        if self.selection is not None:
            raise SelectionWithoutJson(self.view.name, "", "a selection leaves fields out, so only json() and frame() can give it")
        if isinstance(self.keys, list) and not self.keys:
            return []
        return [v for _, v in self._values()]

    def _values(self) -> list[tuple[Any, Record]]:
        q, rows, ctx = self.rows()
        self.tables.spark.sparkContext.setJobDescription(f"shapeframe.load {self.view.name}")
        found = self._run(rows.collect)
        decoder = Decoder({name: self._run(df.collect) for name, df in ctx.closures.items()})
        log.debug("load view=%s queries=%d rows=%d", self.view.name, q.query_count(), len(found))
        return [(r[q.key_alias], decoder.value(q, r[VALUE], r, ())) for r in found]

    def optional(self) -> Record | None:
        found = self._with(limit_=2 if self.limit_ is None else min(2, self.limit_)).all()
        if len(found) > 1:
            raise TooManyRows(self.view.name, self.count())
        return found[0] if found else None

    def one(self) -> Record:
        found = self.optional()
        if found is None:
            raise NotFound(self.view.name, "", "no row found")
        return found

    def json(self) -> list[Any]:
        if self.selection is None:
            self._no_graph()
        if isinstance(self.keys, list) and not self.keys:
            return []
        return [to_json(v, self.view.fields, self.view.name) for _, v in self._values()]

    def graph(self):
        from .graph import load_graph

        if self.selection is not None:
            raise SelectionWithoutJson(self.view.name, "", "a graph is loaded whole")
        return load_graph(self)

    def graph_json(self) -> list[Any]:
        from .graph import graph_json

        return graph_json(self.graph())

    def stream(self) -> Iterator[Record]:
        from ..streaming.batches import stream

        return stream(self)

    def json_stream(self) -> Iterator[Any]:
        from ..streaming.batches import json_stream

        return json_stream(self)

    def _no_graph(self) -> None:
        if self.view.has_graph_edges() and self.selection is None:
            raise GraphRequired(self.view.name, "", "the view has references into a graph; load it with graph()")

    def _run(self, action: Callable[[], Any]) -> Any:
        try:
            return action()
        except PySparkException as e:
            raise translated(e) from e
        except Exception as e:
            raise translated(e) from e


__all__ = ["Child", "Load", "query_rows"]
