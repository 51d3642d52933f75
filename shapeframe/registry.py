"""Registered views with override SQL: checked, explained, shadowed and reloaded."""

from __future__ import annotations

import hashlib
import logging
import threading
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import manifest as manifests
from .errors import CheckError, Invalid, NotRegistered, ParamsError, PlanError, QueryError, WrongBackend
from .manifest import Manifest, key_class
from .operators.flat import column
from .operators.load import Load
from .plans.plan import Query, plan
from .plans.sqltext import explain, parameters, render
from .report import Report, did_you_mean
from .shapes import View, accepts
from .sources.overrides import Override, Source, parse_sources, read_sources
from .sources.tables import Tables

log = logging.getLogger("shapeframe")


@dataclass
class ShadowStats:
    runs: int = 0
    mismatches: int = 0
    override_seconds: float = 0.0
    generated_seconds: float = 0.0


@dataclass(frozen=True)
class State:
    """What loads run with; replaced as a whole."""

    overrides: dict[str, dict[str, Override]]
    fingerprint: str
    report: Report
    stats: dict[tuple[str, str], ShadowStats] = field(default_factory=dict)


class Builder:
    def __init__(self):
        self.views: list[View] = []
        self.folders: list[str] = []
        self.inline: list[Source] = []
        self.invalid = "fail"

    def register(self, view: View) -> Builder:
        self.views.append(view)
        return self

    def overrides_dir(self, folder: str) -> Builder:
        self.folders.append(folder)
        return self

    def overrides(self, view: str, toml: str) -> Builder:
        self.inline.append(Source(view, f"<{view}.toml>", "toml", toml))
        return self

    def overrides_sql(self, view: str, sql: str) -> Builder:
        self.inline.append(Source(view, f"<{view}.sql>", "sql", sql))
        return self

    def on_invalid(self, what: str) -> Builder:
        """``fail``, or ``use_generated`` to leave invalid overrides out."""
        self.invalid = what
        return self

    def manifest(self) -> Manifest:
        return manifests.build(self.views)

    def check(self, tables: Tables) -> Report:
        return self._state(tables)[0].report

    def build(self, tables: Tables) -> Registry:
        state, bad = self._state(tables)
        if state.report.errors and self.invalid == "fail":
            raise Invalid(state.report)
        return Registry(self, tables, self._without(state, bad))

    def _without(self, state: State, bad: set[tuple[str, str]]) -> State:
        kept = {v: {q: o for q, o in qs.items() if (v, q) not in bad} for v, qs in state.overrides.items()}
        return State(kept, state.fingerprint, state.report, state.stats)

    def _state(self, tables: Tables) -> tuple[State, set[tuple[str, str]]]:
        report = Report()
        sources = [*read_sources(self.folders, report), *self.inline]
        fingerprint = hashlib.sha256("\0".join(f"{s.file}\0{s.content}" for s in sources).encode()).hexdigest()
        by_view = {f.view: f for f in parse_sources(sources, report)}
        overrides: dict[str, dict[str, Override]] = {}
        bad: set[tuple[str, str]] = set()
        names = [v.name for v in self.views]
        for f in by_view.values():
            if f.view not in names:
                report.add("M0101", f.view, "", f"no view has this name{did_you_mean(f.view, names)}", origin=f"{f.file}:1")
        for view in self.views:
            try:
                root = plan(view)
            except PlanError as e:
                report.add("M0301", view.name, "", str(e))
                continue
            queries = {q.name: q for q in root.walk()}
            mine = by_view[view.name].queries if view.name in by_view else {}
            overrides[view.name] = {}
            for name, o in mine.items():
                if name not in queries:
                    report.add("M0101", view.name, name, f"no query has this name{did_you_mean(name, queries)}", origin=o.origin)
                else:
                    overrides[view.name][name] = o
            for name, q in queries.items():
                o = overrides[view.name].get(name)
                valid = True
                if o is not None:
                    valid = check_query(tables, root, q, o.sql, o.origin, report)
                    if not valid:
                        bad.add((view.name, name))
                replaced = o is not None and valid and not o.shadow
                own = Report()
                check_query(tables, root, q, render(q), "", own)
                for d in own.diagnostics:
                    report.add(d.code, d.view, d.query, *d.notes, severity="warning" if replaced else d.severity)
        return State(overrides, fingerprint, report), bad


def check_query(tables: Tables, root: Query, q: Query, sql: str, origin: str, report: Report) -> bool:
    """Analyses the SQL without running it, and compares its columns and parameters with the query."""
    before, view = len(report.errors), root.view.name
    names, takes = parameters(sql)
    if origin:
        if q.link.kind != "root" and not takes:
            report.add("M0104", view, q.name, "the query must take the keys, :keys", origin=origin)
        if q.link.kind != "root" and names:
            report.add("M0104", view, q.name, f"only the root query takes named parameters, not :{names[0]}", origin=origin)
    keys = tables.spark.createDataFrame([], f"key {_key_type(tables, root, q)}")
    try:
        rows = tables.sql(sql, dict.fromkeys(names), keys if takes else None, view, q.name)
        rows.schema  # noqa: B018 analysed here
    except (QueryError, ParamsError) as e:
        report.add("M0103", view, q.name, e.message.splitlines()[0], origin=origin)
        return False
    types: dict[str, str] = {}
    for f in rows.schema:
        if f.name in types:
            report.add("M0102", view, q.name, f"`{f.name}` is selected twice", origin=origin)
        types[f.name] = f.dataType.simpleString()
    wanted = {c.alias: c for c in q.columns}
    left_out = []
    for a, c in wanted.items():
        if a not in types:
            if c.role == "computed" and not origin:
                continue
            optional = (c.type is not None and c.type.nullable) or c.inner
            (left_out.append(a) if optional and c.role in ("field", "computed") else report.add("M0102", view, q.name, f"`{a}` is not selected{did_you_mean(a, types)}", origin=origin))
            continue
        kind = types[a]
        if c.role in ("field", "computed") and c.type and not accepts(c.type, kind) and kind != "void":
            report.add("M0102", view, q.name, f"`{a}` is {kind}, the field is {c.type.scalar}", origin=origin)
        elif c.role == "index" and key_class(kind) != "integer":
            report.add("M0102", view, q.name, f"`{a}` is {kind}, an index is an integer", origin=origin)
        elif c.role in ("key", "parent", "ref") and key_class(kind) not in ("integer", "string"):
            report.add("M0102", view, q.name, f"`{a}` is {kind}, a key is an integer or text", origin=origin)
        elif c.role == "parent" and key_class(kind) != key_class(_key_type(tables, root, q)):
            report.add("M0102", view, q.name, f"`{a}` is {kind}, the key above is {_key_type(tables, root, q)}", origin=origin)
    if origin:
        for a in types:
            if a not in wanted and a not in ("$row",):
                report.add("M0102", view, q.name, f"`{a}` is no path of the view{did_you_mean(a, wanted)}", origin=origin)
    if left_out:
        report.add("M0105", view, q.name, f"always NULL: {', '.join(left_out)}", severity="warning", origin=origin)
    return len(report.errors) == before


def _key_type(tables: Tables, root: Query, q: Query) -> str:
    """Type of the keys that a query takes: those of its parent, or of its own table."""
    above = next((p for p in root.walk() if any(c is q for c in p.children.values())), None)
    owner = above if above is not None and q.link.kind == "child" else q
    try:
        return tables.table(owner.table).schema[owner.key_column].dataType.simpleString()
    except Exception:
        return "bigint"


class Active:
    """The overrides that one load captured."""

    def __init__(self, registry: Registry, view: View, state: State):
        self.registry, self.view, self.state = registry, view, state

    def get(self, name: str) -> Override | None:
        return self.state.overrides.get(self.view.name, {}).get(name)

    def root(self, q: Query) -> Override | None:
        return self.get("$root")

    def rows(self, load: Load, q: Query, keys: DataFrame | None) -> DataFrame | None:
        o = self.get(q.name)
        if o is None:
            return None
        if keys is None:  # the load is of all roots: the keys are all that the rows above have
            keys = self._all_keys(load, q)
        rows = load.tables.sql(o.sql, None, keys, self.view.name, q.name)
        if o.shadow:
            self.compare(load, q, rows, keys)
        return rows

    def _all_keys(self, load: Load, q: Query) -> DataFrame:
        above = next(p for p in plan(self.view, load.selection).walk() if any(c is not None and getattr(c, "name", None) == q.name for c in p.children.values()))
        table = load.tables.table(above.table)
        name = q.link.fk if q.link.kind == "to_one" else above.key_column
        return table.select(F.col(f"`{name}`").alias("key")).where("key IS NOT NULL").distinct()

    def compare(self, load: Load, q: Query, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Shadow: counts a run, and a mismatch if the generated query's rows differ in what the override selects."""
        from .operators.flat import generated

        stats = self.state.stats.setdefault((self.view.name, q.name), ShadowStats())
        if q.link.kind == "root":
            own = load._with(text=None, params={})
            own.overrides = None
            mine = own.root(q)
        else:
            link = load.tables.table(q.link.field.through) if q.link.kind == "child" and q.link.field.through else None
            mine = generated(q, load.tables.table(q.table), link, keys, None)
        shared = [c for c in rows.columns if c in mine.columns and c in {x.alias for x in q.columns}]
        a, b = rows.select(*map(column, shared)), mine.select(*map(column, shared))
        start = time.perf_counter()
        extra = a.exceptAll(b).count()
        middle = time.perf_counter()
        missing = b.exceptAll(a).count()
        stats.override_seconds += middle - start
        stats.generated_seconds += time.perf_counter() - middle
        stats.runs += 1
        if extra or missing:
            stats.mismatches += 1
            log.warning("shadow mismatch view=%s query=%s extra=%d missing=%d", self.view.name, q.name, extra, missing)


class Registry:
    """Loads views with overrides. A load keeps the state it began with; ``reload`` swaps in a new one or none."""

    def __init__(self, builder: Builder, tables: Tables, state: State):
        self.builder, self.tables, self.state = builder, tables, state
        self.lock, self.rejected = threading.Lock(), ""

    @staticmethod
    def builder() -> Builder:
        return Builder()

    def _registered(self, view: View) -> None:
        if view not in self.builder.views:
            raise NotRegistered(view.name, "", "register it with Registry.builder().register(...)")

    def load(self, view: View, tables: Tables | None = None) -> Load:
        self._registered(view)
        tables = tables or self.tables
        if tables.BACKEND != self.tables.BACKEND:
            raise WrongBackend(view.name, "", f"the registry was built for {self.tables.BACKEND}, not {tables.BACKEND}")
        return Load(view, tables, Active(self, view, self.state))

    def plan(self, view: View) -> Query:
        self._registered(view)
        return plan(view)

    @property
    def report(self) -> Report:
        return self.state.report

    def explain(self, view: View) -> str:
        self._registered(view)
        return explain(plan(view), self.state.overrides.get(view.name))

    def shadow_stats(self, view: View, query: str) -> ShadowStats:
        return self.state.stats.get((view.name, query), ShadowStats())

    def reload(self) -> bool:
        """Reads and checks the files again; swaps them in if they changed and are valid. Invalid ones raise and change nothing."""
        with self.lock:
            try:
                state, bad = self.builder._state(self.tables)
            except OSError as e:
                raise CheckError("", "", str(e)) from e
            if state.fingerprint == self.state.fingerprint:
                return False
            if state.report.errors and self.builder.invalid == "fail":
                self.rejected = state.fingerprint
                raise Invalid(state.report)
            kept = {k: v for k, v in self.state.stats.items() if state.overrides.get(k[0], {}).get(k[1]) and self.state.overrides.get(k[0], {}).get(k[1]) and state.overrides[k[0]][k[1]].sql == self.state.overrides[k[0]][k[1]].sql}
            fresh = self.builder._without(state, bad)
            self.state = State(fresh.overrides, fresh.fingerprint, fresh.report, kept)
            return True


def scaffold(view: View, format: str = "toml", queries: list[str] | None = None) -> str:
    """An override file of a view's generated SQL."""
    return manifests.build([view]).scaffold(view.name, format, queries)


__all__: list[Any] = ["Builder", "Registry", "scaffold"]
