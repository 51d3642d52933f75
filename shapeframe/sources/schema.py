"""Schema snapshots: what tables look like, as JSON to be committed and compared."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from .tables import Tables

FORMAT = 1


@dataclass
class ColumnInfo:
    name: str
    type: str
    nullable: bool = True
    generated: bool = False


@dataclass
class TableInfo:
    name: str
    columns: list[ColumnInfo]
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[tuple[list[str], str, list[str]]] = field(default_factory=list)
    view: bool = False

    def column(self, name: str) -> ColumnInfo | None:
        return next((c for c in self.columns if c.name == name), None) or next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass
class Snapshot:
    tables: list[TableInfo]
    backend: str = Tables.BACKEND
    format: int = FORMAT

    def __post_init__(self):
        self.tables.sort(key=lambda t: t.name)

    def table(self, name: str) -> TableInfo | None:
        return next((t for t in self.tables if t.name == name), None) or next((t for t in self.tables if t.name.lower() == name.lower()), None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True) + "\n"

    @staticmethod
    def from_json(text: str) -> Snapshot:
        d = json.loads(text)
        tables = [TableInfo(t["name"], [ColumnInfo(**c) for c in t["columns"]], t["primary_key"], [tuple(f) for f in t["foreign_keys"]], t["view"]) for t in d["tables"]]
        return Snapshot(tables, d["backend"], d["format"])

    def differences(self, actual: Snapshot) -> list[str]:
        """How the actual schema differs, a line each."""
        if self.backend != actual.backend:
            return [f"the snapshot is of {self.backend}, the tables are of {actual.backend}"]
        mine, theirs = {t.name: t for t in self.tables}, {t.name: t for t in actual.tables}
        out = [f"table {n} is only in the snapshot" for n in mine if n not in theirs]
        for n, t in theirs.items():
            if n not in mine:
                out.append(f"table {n} is not in the snapshot")
                continue
            old, new = {c.name: c for c in mine[n].columns}, {c.name: c for c in t.columns}
            out += [f"column {n}.{c} is only in the snapshot" for c in old if c not in new]
            out += [f"column {n}.{c} is not in the snapshot" for c in new if c not in old]
            for c in old.keys() & new.keys():
                for what in ("type", "nullable", "generated"):
                    a, b = getattr(old[c], what), getattr(new[c], what)
                    if a != b:
                        out.append(f"column {n}.{c}: {what} was {a}, is {b}")
            if mine[n].primary_key != t.primary_key:
                out.append(f"table {n}: primary key was {mine[n].primary_key}, is {t.primary_key}")
            if sorted(map(str, map(tuple, mine[n].foreign_keys))) != sorted(map(str, map(tuple, t.foreign_keys))):
                out.append(f"table {n}: foreign keys differ")
        return out


def snapshot(tables: Tables, names: list[str] | None = None, declared: dict[str, dict[str, Any]] | None = None) -> Snapshot:
    """A snapshot of tables. Parquet knows no keys and no NOT NULL, so they may be declared:
    {table: {"primary_key": [...], "foreign_keys": [...], "not_null": [...], "generated": [...]}}."""
    out = []
    for name in names or tables.names():
        d = (declared or {}).get(name, {})
        columns = [ColumnInfo(f.name, f.dataType.simpleString(), f.nullable and f.name not in d.get("not_null", []), f.name in d.get("generated", [])) for f in tables.table(name).schema]
        out.append(TableInfo(name, columns, list(d.get("primary_key", [])), [tuple(f) for f in d.get("foreign_keys", [])], bool(d.get("view", False))))
    return Snapshot(out)
