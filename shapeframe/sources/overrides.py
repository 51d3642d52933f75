"""Override files: SQL that replaces queries of a view. One file per view, ``<View>.toml`` or ``<View>.sql``."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from pathlib import Path

from ..report import Report


@dataclass(frozen=True)
class Override:
    sql: str
    shadow: bool
    origin: str


@dataclass(frozen=True)
class OverrideFile:
    view: str
    file: str
    queries: dict[str, Override]


@dataclass(frozen=True)
class Source:
    view: str
    file: str
    format: str
    content: str


#: The line that opens a query in an .sql file.
_MARK = re.compile(r"^--\s*shapeframe:\s*query\s+(\S+?)\s*(,\s*shadow)?\s*$")


def read_sources(folders: list[str], report: Report) -> list[Source]:
    out = []
    for folder in folders:
        try:
            files = sorted(p for p in Path(folder).iterdir() if p.suffix in (".toml", ".sql"))
        except OSError as e:
            report.add("M0100", "", "", f"cannot read the folder: {e}", origin=f"{folder}:1")
            continue
        for p in files:
            try:
                out.append(Source(p.stem, str(p), p.suffix[1:], p.read_text(encoding="utf-8")))
            except (OSError, UnicodeDecodeError) as e:
                report.add("M0100", p.stem, "", f"cannot read the file: {e}", origin=f"{p}:1")
    return out


def parse_sources(sources: list[Source], report: Report) -> list[OverrideFile]:
    out: dict[str, OverrideFile] = {}
    for s in sources:
        if s.view in out:
            report.add("M0100", s.view, "", f"{s.view} already has an override file, {out[s.view].file}", origin=f"{s.file}:1")
            continue
        try:
            queries = _toml(s) if s.format == "toml" else _sql(s)
        except ValueError as e:
            report.add("M0100", s.view, "", str(e), origin=f"{s.file}:1")
            continue
        out[s.view] = OverrideFile(s.view, s.file, queries)
    return list(out.values())


def _toml(s: Source) -> dict[str, Override]:
    doc = tomllib.loads(s.content)
    if extra := set(doc) - {"query"}:
        raise ValueError(f"unknown field {sorted(extra)[0]!r}")
    out = {}
    for name, body in doc.get("query", {}).items():
        if not isinstance(body, dict) or not isinstance(body.get("sql"), str) or set(body) - {"sql", "shadow"} or not isinstance(body.get("shadow", False), bool):
            raise ValueError(f"query {name!r} takes sql and shadow")
        line = next((i for i, text in enumerate(s.content.splitlines(), 1) if name in text), 1)
        out[name] = Override(body["sql"], body.get("shadow", False), f"{s.file}:{line}")
    return out


def _sql(s: Source) -> dict[str, Override]:
    out: dict[str, Override] = {}
    name, shadow, start, lines = None, False, 0, []

    def close() -> None:
        text = "\n".join(lines).strip().rstrip(";").strip()
        if name is None:
            if any(x.strip() and not x.strip().startswith("--") for x in lines):
                raise ValueError("SQL before the first query line")
            return
        if not text:
            raise ValueError(f"query {name} has no SQL")
        if name in out:
            raise ValueError(f"query {name} is given twice")
        out[name] = Override(text, shadow, f"{s.file}:{start}")

    for i, line in enumerate(s.content.splitlines(), 1):
        if m := _MARK.match(line.strip()):
            close()
            name, shadow, start, lines = m[1], bool(m[2]), i, []
        else:
            lines.append(line)
    close()
    return out
