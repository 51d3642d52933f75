"""Command line: ``python -m shapeframe check|explain|scaffold|schema``. Exit status: 0 fine, 1 found something, 2 used wrongly."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .errors import ShapeframeError
from .manifest import Manifest
from .report import Report
from .sources.overrides import parse_sources, read_sources
from .sources.schema import Snapshot, snapshot
from .sources.tables import Tables


def _tables(folder: str, spark=None) -> Tables:
    from pyspark.sql import SparkSession

    return Tables(spark or SparkSession.builder.getOrCreate(), folder)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shapeframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check", help="check override files, and the views against a snapshot or tables")
    check.add_argument("--manifest", required=True)
    check.add_argument("--overrides", action="append", default=[])
    check.add_argument("--snapshot")
    check.add_argument("--tables", help="folder of Parquet tables")
    explain = sub.add_parser("explain", help="the queries of a view")
    explain.add_argument("--manifest", required=True)
    explain.add_argument("view")
    scaffold = sub.add_parser("scaffold", help="an override file of the generated SQL")
    scaffold.add_argument("--manifest", required=True)
    scaffold.add_argument("view")
    scaffold.add_argument("--format", choices=("toml", "sql"), default="toml")
    scaffold.add_argument("--query", action="append")
    scaffold.add_argument("--out", help="folder of the view's override file")
    schema = sub.add_parser("schema", help="write a snapshot, or compare the tables with one")
    schema.add_argument("--tables", required=True)
    schema.add_argument("--declared", help="JSON file of declared keys and constraints")
    schema.add_argument("--table", action="append", required=True)
    schema.add_argument("--out")
    schema.add_argument("--check")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    try:
        a = _parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return {"check": _check, "explain": _explain, "scaffold": _scaffold, "schema": _schema}[a.command](a, spark)
    except (ShapeframeError, OSError, ValueError, KeyError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _manifest(path: str) -> Manifest:
    return Manifest.from_json(Path(path).read_text(encoding="utf-8"))


def _check(a, spark) -> int:
    m, report = _manifest(a.manifest), Report()
    for f in parse_sources(read_sources(a.overrides, report), report):
        entry = next((v for v in m.views if v.name == f.view), None)
        queries = {q.name: q for q in entry.queries} if entry else {}
        for name, o in f.queries.items():
            if name not in queries:
                report.add("M0101", f.view, name, origin=o.origin)
            elif a.tables:
                _prepare(_tables(a.tables, spark), f.view, queries[name], o.sql, o.origin, report)
    if a.tables:
        for v in m.views:
            for q in v.queries:
                _prepare(_tables(a.tables, spark), v.name, q, q.sql, "", report)
    if a.snapshot:
        report.diagnostics += m.check_snapshot(Snapshot.from_json(Path(a.snapshot).read_text(encoding="utf-8"))).diagnostics
    print(report if report.diagnostics else "no problems")
    return int(not report.ok())


def _prepare(tables: Tables, view: str, q, sql: str, origin: str, report: Report) -> None:
    from .plans.sqltext import parameters

    names, takes = parameters(sql)
    if origin and q.parent is not None and not takes:
        report.add("M0104", view, q.name, "the query must take the keys, :keys", origin=origin)
    try:
        rows = tables.sql(sql, dict.fromkeys(names), tables.spark.createDataFrame([], "key bigint") if takes else None, view, q.name)
    except ShapeframeError as e:
        report.add("M0103", view, q.name, e.message.splitlines()[0], origin=origin)
        return
    for c in q.columns:
        if c.alias not in rows.columns and not (c.optional or c.inner or c.role == "computed"):
            report.add("M0102", view, q.name, f"`{c.alias}` is not selected", origin=origin)


def _explain(a, spark) -> int:
    print(_manifest(a.manifest).explain(a.view))
    return 0


def _scaffold(a, spark) -> int:
    m = _manifest(a.manifest)
    print(m.scaffold_into(a.out, a.view, a.format, a.query) if a.out else m.scaffold(a.view, a.format, a.query))
    return 0


def _schema(a, spark) -> int:
    declared = json.loads(Path(a.declared).read_text(encoding="utf-8")) if a.declared else None
    now = snapshot(_tables(a.tables, spark), a.table, declared)
    if a.check:
        found = Snapshot.from_json(Path(a.check).read_text(encoding="utf-8")).differences(now)
        print("\n".join(found) if found else "the snapshot is up to date")
        return int(bool(found))
    if a.out:
        Path(a.out).write_text(now.to_json(), encoding="utf-8")
    else:
        print(now.to_json(), end="")
    return 0
