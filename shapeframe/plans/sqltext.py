"""SQL text: reading parameters of a user's SQL, and writing a query of a plan as Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from .plan import Query

#: Literals, quoted names and comments are stepped over; a cast's :: is no parameter.
_PIECES = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|::|:([A-Za-z_]\w*)|\$1(?!\d)", re.S)
KEYS = "shapeframe_keys"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def parameters(sql: str) -> tuple[list[str], bool]:
    """(named parameters in order, whether the text takes the keys)."""
    names, keys = [], False
    for m in _PIECES.finditer(sql):
        if m[0] == "$1" or m[1] == "keys":
            keys = True
        elif m[1] and m[1] not in names:
            names.append(m[1])
    return names, keys


def replace(sql: str, put: Callable[[str], str | None]) -> str:
    """The text, each parameter (or ``keys``) replaced unless put gives None."""

    def one(m: re.Match) -> str:
        name = "keys" if m[0] == "$1" else m[1]
        new = put(name) if name else None
        return m[0] if new is None else new

    return _PIECES.sub(one, sql)


def with_keys(sql: str, relation: str = KEYS) -> str:
    """Keys as a relation: ``IN (:keys)`` and ``= ANY(:keys)`` become an IN over a subquery."""
    marked = replace(sql, lambda n: "\u0001" if n == "keys" else None)
    inner = f"SELECT `key` FROM {relation}"
    marked = re.sub(r"=\s*ANY\s*\(\s*\u0001\s*\)", f"IN ({inner})", marked, flags=re.I)
    return marked.replace("\u0001", inner)


def render(q: Query) -> str:
    """The query that the plan runs, as Spark SQL; ``:keys`` stands for the keys of the rows above."""
    if q.closure:
        return _closure(q)
    link = q.link.field if q.link.kind == "child" else None
    through = link.through if link else None
    columns = [_column(c) for c in q.columns if c.role != "computed"]
    sql = f"SELECT {', '.join(columns)} FROM {quote(q.table)} AS t"
    if through:
        sql += f" JOIN {quote(through)} AS j ON j.{quote(link.target)} = t.{quote(q.key_column)} WHERE j.{quote(link.fk)} IN (:keys)"
    elif link:
        sql += f" WHERE t.{quote(link.fk)} IN (:keys)"
    elif q.link.kind != "root":
        sql += f" WHERE t.{quote(q.key_column)} IN (:keys)"
    if link:
        sql += " ORDER BY " + ", ".join(f"t.{quote(c)} {'DESC NULLS FIRST' if d else 'ASC NULLS LAST'}" for c, d in q.order())
    return sql


def _column(c) -> str:
    side = "j" if c.side == "link" else "t"
    what = f"{side}.{quote(c.column)}"
    return f"CAST({what} AS STRING) AS {quote(c.alias)}" if c.role == "tag" else f"{what} AS {quote(c.alias)}"


def _closure(q: Query) -> str:
    key, fk = quote(q.key_column), quote(q.link.fk)
    if q.link.kind == "child":
        anchor, step = f"t.{fk} IN (:keys)", f"t.{fk} = r.k"
        carried, guard = f"t.{key}", f"t.{key}"
    else:
        anchor, step = f"t.{key} IN (:keys)", f"t.{key} = r.n"
        carried, guard = f"t.{key}", f"t.{key}"
    most = f" AND size(r.p) < {q.link.field.depth}" if q.link.kind == "child" and q.link.field.depth else ""
    follow = f", t.{fk} AS n" if q.link.kind == "to_one" else ""
    inner = f"SELECT {carried} AS k, array(t.{key}) AS p{follow} FROM {quote(q.table)} t WHERE {anchor} UNION ALL SELECT {carried}, concat(r.p, array(t.{key})){follow.replace(' AS n', '')} FROM {quote(q.table)} t JOIN tree r ON {step} WHERE NOT array_contains(r.p, {guard}){most}"
    columns = ", ".join(_column(c) for c in q.columns if c.role != "computed")
    names = "k, p, n" if follow else "k, p"
    return f"WITH RECURSIVE tree({names}) AS ({inner}) SELECT {columns} FROM {quote(q.table)} AS t JOIN (SELECT DISTINCT k FROM tree) d ON d.k = t.{key}"


def explain(q: Query, overrides: dict | None = None, depth: int = 0) -> str:
    """The tree of queries with their SQL, generated or overridden."""
    from .plan import Repeat

    pad, over = "  " * depth, (overrides or {}).get(q.name)
    lines = [f"{pad}{q.name}: {q.owner}{q.link.describe()}"]
    if over:
        lines.append(f"{pad}  override ({over.origin}{', shadowed' if over.shadow else ''}):")
        lines += [f"{pad}    {line.rstrip()}" for line in over.sql.strip().splitlines()]
    else:
        lines.append(f"{pad}  {render(q)}")
    for path, child in q.children.items():
        if child is None:
            lines.append(f"{pad}  {path}: rows of every level, found by the closure above")
        elif isinstance(child, Repeat):
            lines.append(f"{pad}  {path}: unrolled from the query {child.up} above, to depth {child.depth}")
        else:
            lines.append(explain(child, overrides, depth + 1))
    return "\n".join(lines)
