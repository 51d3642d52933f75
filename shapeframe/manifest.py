"""Manifests: views and their queries as JSON, for checks, explanations and scaffolds without the code that declares them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .errors import ManifestBackend, PlanError, ShapeframeError
from .plans.plan import Query, plan
from .plans.sqltext import render
from .report import Report
from .shapes import Column, View
from .sources.overrides import parse_sources, read_sources
from .sources.schema import Snapshot
from .sources.tables import Tables

FORMAT = 2


@dataclass
class ColumnEntry:
    alias: str
    column: str
    role: str
    side: str
    optional: bool
    inner: bool
    scalar: str | None = None
    list: bool = False


@dataclass
class QueryEntry:
    name: str
    view: str
    parent: int | None
    link: dict
    table: str
    key_column: str
    key_alias: str
    generated: bool
    sql: str
    columns: list[ColumnEntry] = field(default_factory=list)


@dataclass
class ViewEntry:
    name: str
    queries: list[QueryEntry] = field(default_factory=list)


@dataclass
class Manifest:
    views: list[ViewEntry]
    backend: str = Tables.BACKEND
    format: int = FORMAT

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True) + "\n"

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        views = [ViewEntry(v["name"], [QueryEntry(**(q | {"columns": [ColumnEntry(**c) for c in q["columns"]]})) for q in v["queries"]]) for v in d["views"]]
        return Manifest(views, d["backend"], d["format"])

    def write(self, path: str) -> bool:
        """Writes the file if it would change; tells whether it did."""
        text = self.to_json()
        if os.path.exists(path) and Path(path).read_text(encoding="utf-8") == text:
            return False
        Path(path).write_text(text, encoding="utf-8")
        return True

    def view(self, name: str) -> ViewEntry:
        found = next((v for v in self.views if v.name == name), None)
        if found is None:
            raise ShapeframeError(name, "", "the manifest has no such view")
        return found

    def explain(self, name: str) -> str:
        v, lines, depth = self.view(name), [], {}
        for i, q in enumerate(v.queries):
            depth[i] = 0 if q.parent is None else depth[q.parent] + 1
            lines += [f"{'  ' * depth[i]}{q.name}: {q.view}{q.link['text']}", f"{'  ' * depth[i]}  {q.sql}"]
        return "\n".join(lines)

    def scaffold(self, name: str, format: str = "toml", queries: list[str] | None = None) -> str:
        """An override file of the generated SQL, of all queries or the named ones."""
        v = self.view(name)
        if missing := [n for n in queries or [] if n not in {q.name for q in v.queries}]:
            raise ShapeframeError(name, missing[0], "the view has no such query")
        chosen = [q for q in v.queries if queries is None or q.name in queries]
        if format == "toml":
            return "\n".join(f'[query.{json.dumps(q.name)}]\nsql = """\n{q.sql}\n"""\n' for q in chosen)
        return "\n".join(f"-- shapeframe: query {q.name}\n{q.sql}\n" for q in chosen)

    def scaffold_into(self, folder: str, name: str, format: str = "toml", queries: list[str] | None = None) -> str:
        """Adds to the view's file in a folder; never replaces a query, nor starts a second file for a view."""
        other = Path(folder) / f"{name}.{'sql' if format == 'toml' else 'toml'}"
        if other.exists():
            raise ShapeframeError(name, "", f"the view already has {other}")
        path, old = Path(folder) / f"{name}.{format}", ""
        text = self.scaffold(name, format, queries)
        if path.exists():
            report = Report()
            have = [f for f in parse_sources(read_sources([folder], report), report) if f.view == name]
            wanted = queries or [q.name for q in self.view(name).queries]
            if twice := [q for f in have for q in f.queries if q in wanted]:
                raise ShapeframeError(name, twice[0], f"{path} already overrides the query")
            old = path.read_text(encoding="utf-8").rstrip("\n") + "\n\n"
        path.write_text(old + text, encoding="utf-8")
        return str(path)

    def check_snapshot(self, snapshot: Snapshot) -> Report:
        """The views against a schema, without tables."""
        if snapshot.backend != self.backend:
            raise ManifestBackend("", "", f"the manifest is of {self.backend}, the snapshot of {snapshot.backend}")
        report = Report()
        for v in self.views:
            for q in v.queries:
                self._check_query(v, q, snapshot, report)
        return report

    def _check_query(self, v: ViewEntry, q: QueryEntry, snapshot: Snapshot, report: Report) -> None:
        from .shapes import ValueType, accepts

        t = snapshot.table(q.table)
        if t is None:
            report.add("M0201", v.name, q.name, f"table {q.table}")
            return
        link = snapshot.table(q.link["through"]) if q.link.get("through") else None
        if q.link.get("through") and link is None:
            report.add("M0201", v.name, q.name, f"table {q.link['through']}")
        for c in q.columns:
            where = link if c.side == "link" else t
            if where is None or c.role == "computed":
                continue
            found = where.column(c.column)
            if found is None:
                report.add("M0202", v.name, q.name, f"column {where.name}.{c.column}")
            elif c.scalar and c.role == "field":
                if not accepts(ValueType(c.scalar, c.optional, c.list), found.type):
                    report.add("M0203", v.name, q.name, f"{where.name}.{c.column} is {found.type}, {c.alias} is {c.scalar}")
                if found.nullable and not c.optional and not c.inner and not t.view:
                    report.add("M0204", v.name, q.name, f"{where.name}.{c.column} may be NULL", severity="warning")
        key = t.column(q.key_column)
        if key is None:
            report.add("M0202", v.name, q.name, f"column {t.name}.{q.key_column}")
            return
        if not t.view and t.primary_key != [q.key_column]:
            report.add("M0206", v.name, q.name, f"{t.name}.{q.key_column}, the primary key is {t.primary_key}", severity="warning")
        if q.generated and not key.generated:
            report.add("M0207", v.name, q.name, f"{t.name}.{q.key_column}")
        if q.parent is not None:
            above = v.queries[q.parent]
            parent = snapshot.table(above.table)
            pairs = []
            if q.link["kind"] == "child":
                own = (link or t).column(q.link["fk"]) if (link or t) else None
                pairs.append((parent.column(above.key_column) if parent else None, own))
                if link:
                    pairs.append((key, link.column(q.link["target"])))
            elif q.link["kind"] == "to_one" and parent:
                pairs.append((key, parent.column(q.link["fk"])))
            for a, b in pairs:
                if a and b and key_class(a.type) != key_class(b.type):
                    report.add("M0205", v.name, q.name, f"{a.name} is {a.type}, {b.name} is {b.type}")


def key_class(spark_type: str) -> str:
    return "integer" if spark_type in ("tinyint", "smallint", "int", "bigint") else spark_type.split("(")[0]


def build(views: list[View], report: Report | None = None) -> Manifest:
    out = []
    for view in views:
        try:
            q = plan(view)
        except PlanError as e:
            if report is None:
                raise
            report.add("M0301", view.name, "", str(e))
            continue
        queries = q.walk()
        entry = ViewEntry(view.name)
        for x in queries:
            parent = next((i for i, p in enumerate(queries) if any(c is x for c in p.children.values())), None)
            at = x.link.field
            link = {"kind": x.link.kind, "fk": x.link.fk, "alias": x.link.alias, "tag": x.link.tag, "text": x.link.describe()}
            if x.link.kind == "child":
                link |= {"through": at.through, "target": at.target, "index": at.index, "key": at.key}
            generated = any(isinstance(f, Column) and f.generated for f in x.fields.values())
            columns = [ColumnEntry(c.alias, c.column, c.role, c.side, _optional(x, c), c.inner, c.type.scalar if c.type else None, bool(c.type and c.type.list)) for c in x.columns]
            entry.queries.append(QueryEntry(x.name, x.owner, parent, link, x.table, x.key_column, x.key_alias, generated, render(x), columns))
        out.append(entry)
    return Manifest(out)


def _optional(q: Query, c) -> bool:
    if c.role == "ref":
        return q.fields[c.alias.removeprefix("$ref.")].optional
    return bool(c.type and c.type.nullable)


def ci(manifest: str, snapshot: str, overrides: list[str] | None = None, skip: bool = False) -> Report:
    """The check of a continuous build: a committed manifest against a committed snapshot, and the override files' syntax and names."""
    report = Report()
    if skip or not os.path.exists(manifest):
        return report
    m = Manifest.from_json(Path(manifest).read_text(encoding="utf-8"))
    report.diagnostics += m.check_snapshot(Snapshot.from_json(Path(snapshot).read_text(encoding="utf-8"))).diagnostics
    for f in parse_sources(read_sources(overrides or [], report), report):
        entry = next((v for v in m.views if v.name == f.view), None)
        for name, o in f.queries.items():
            if entry is None or name not in {q.name for q in entry.queries}:
                report.add("M0101", f.view, name, origin=o.origin)
    return report
