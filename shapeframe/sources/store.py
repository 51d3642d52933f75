"""Writing aggregates: tables as immutable versions, and one head that names the current ones.

A write computes new frames for all tables that it touches, writes them to new folders, and then replaces the head at
once: all of it is seen, or nothing. Frames that were read before keep their version. Rows are merged by sets: one anti
join and union per table and level, whatever the number of values.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, WriteError
from ..operators.decode import Record
from ..plans.sqltext import quote
from ..shapes import Child, Column, Embed, Embedded, Field, Sum, ToOne, View
from .tables import Tables


class Store:
    """A folder of versioned tables, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions -------------------------------------------------------------------------------------------------------

    def _head_number(self) -> int:
        found = self._fs.globStatus(self._fs_path(f"{self.folder}/head-*.json"))
        return max((int(s.getPath().getName()[5:-5]) for s in found or []), default=0)

    def head(self, version: int | None = None) -> dict[str, str]:
        n = self._head_number() if version is None else version
        if not n:
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/head-{n}.json", wholetext=True).collect()))

    def version(self) -> int:
        return self._head_number()

    def latest(self) -> Tables:
        return self.at_version(self.version())

    def at_version(self, version: int) -> Tables:
        """The tables as of a version: a snapshot, whatever is written later."""
        head = self.head(version)
        return Tables(self.spark, {name: self.spark.read.parquet(f"{self.folder}/{path}") for name, path in head.items()})

    def create(self, **tables: DataFrame) -> None:
        self.commit(tables, self.version())

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Writes the tables' new versions; fails if the head moved since base. The head's file is made without
        overwriting, so of two writers one wins."""
        head = self.head(base)
        for name, df in tables.items():
            path = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{path}")
            head[name] = path
        target = self._fs_path(f"{self.folder}/head-{base + 1}.json")
        try:
            out = self._fs.create(target, False)
        except Exception as e:
            raise Conflict("", "", f"version {base + 1} was written meanwhile") from e
        out.write(bytearray(json.dumps(head, sort_keys=True).encode()))
        out.close()
        return base + 1

    # Writes ---------------------------------------------------------------------------------------------------------

    def save(self, view: View, value: dict[str, Any]) -> Record:
        return self.save_all(view, [value])[0]

    def save_all(self, view: View, values: Iterable[dict[str, Any]]) -> list[Record]:
        """Creates or replaces the values and what they own; gives them back with generated keys and new versions."""
        w = Write(self)
        out = [w.value(view, Record(v)) for v in values]
        w.commit()
        return out

    def save_changes(self, view: View, before: dict[str, Any], after: dict[str, Any]) -> Record:
        """Writes what changed between two states of one value."""
        w = Write(self)
        out = w.changes(view, Record(before), Record(after))
        w.commit()
        return out

    def delete(self, view: View, key: Any) -> bool:
        """Deletes the row and what it owns; tells whether it existed."""
        w = Write(self)
        existed = bool(w.table(view.table).where(F.col(quote(view.key)) == F.lit(key)).limit(1).count())
        w.remove(view, [key])
        w.commit()
        return existed

    def save_graph(self, graph: Any, changed_only: bool = False) -> None:
        from .graph_write import write_graph

        write_graph(self, graph, changed_only)

    def save_graph_changes(self, graph: Any) -> None:
        self.save_graph(graph, True)


def merge(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows in place of those with equal keys; columns that new lacks keep their old values, or are NULL."""
    lacking = [c for c in old.columns if c not in new.columns]
    k = new.select(*[F.col(quote(c)).alias(f"_{c}") for c in key])
    on = [old[quote(c)].eqNullSafe(F.col(quote(f"_{c}"))) for c in key]
    kept = old.join(k, on, "left_anti")
    if lacking:
        rest = old.select(*[F.col(quote(c)).alias(f"_k_{c}") for c in key], *[F.col(quote(c)).alias(f"_o_{c}") for c in lacking])
        new = new.join(rest, [new[quote(c)].eqNullSafe(F.col(quote(f"_k_{c}"))) for c in key], "left")
        new = new.withColumns({c: F.col(quote(f"_o_{c}")) for c in lacking})
    return kept.unionByName(new.select(*[F.col(quote(f.name)).cast(f.dataType).alias(f.name) for f in old.schema]))


def among(df: DataFrame, column: str, values: list[Any], inside: bool = True) -> DataFrame:
    """Rows whose column is (or isn't) one of the values: literals if they are few, else a join with them as a frame."""
    values = list(dict.fromkeys(v for v in values if v is not None))
    if len(values) <= 200:
        found = F.coalesce(F.col(quote(column)).isin(*values), F.lit(False)) if values else F.lit(False)
        return df.where(found if inside else ~found)
    k = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField("_among", df.schema[column].dataType)]))
    return df.join(k, F.col(quote(column)) == F.col("_among"), "left_semi" if inside else "left_anti")


def without(df: DataFrame, column: str, values: list[Any], key: str | None, kept: list[Any]) -> DataFrame:
    """df less the rows with one of the values, but for those whose key is kept."""
    rest = among(df, column, values, False)
    return rest.unionByName(among(among(df, column, values), key, kept)) if key and kept else rest


def _together(entries: list[tuple[str, list[Any], str | None, list[Any]]]) -> dict[tuple[str, str | None], tuple[list[Any], list[Any]]]:
    """Entries of one column and key as one. (What one of them keeps is written again, so the others may keep it too.)"""
    out: dict[tuple[str, str | None], tuple[list[Any], list[Any]]] = {}
    for column, values, key, kept in entries:
        v, k = out.setdefault((column, key), ([], []))
        v.extend(values)
        k.extend(kept)
    return out


class Write:
    """Collects what a write does to each table, and applies it by sets."""

    def __init__(self, store: Store):
        self.store, self.spark, self.base = store, store.spark, store.version()
        self.before = store.at_version(self.base)
        self.rows: dict[tuple[str, str, tuple[str, ...]], list[dict[str, Any]]] = {}
        self.links: dict[str, list[dict[str, Any]]] = {}
        self.dropped: dict[str, list[tuple[str, list[Any], str | None, list[Any]]]] = {}
        self.versions: list[tuple[View, str, Any, Any, bool]] = []
        self.next_key: dict[str, int] = {}
        self.nulls: dict[str, list[tuple[str, str, list[Any], list[Any]]]] = {}
        self.gone: dict[tuple[str, str], tuple[View, list[Any], list[Any]]] = {}
        self.graph_keys: dict[Any, Any] | None = None  # of a graph that is saved, by reference

    def table(self, name: str) -> DataFrame:
        return self.before.table(name)

    def generated(self, view: View) -> int:
        if view.table not in self.next_key:
            top = self.table(view.table).agg(F.max(quote(view.key))).first()[0]
            self.next_key[view.table] = int(top or 0)
        self.next_key[view.table] += 1
        return self.next_key[view.table]

    def put(self, table: str, key: str, row: dict[str, Any]) -> None:
        self.rows.setdefault((table, key, tuple(sorted(row))), []).append(row)

    def key_of(self, view: View, value: Record, new: bool) -> Any:
        f = view.key_field
        if f is None:
            raise WriteError(view.name, "", "a saved view needs a key field")
        if value.get(f) is None:
            if not view.fields[f].generated or not new:
                raise WriteError(view.name, f, "the value has no key")
            value[f] = self.generated(view)
        return value[f]

    # Values ---------------------------------------------------------------------------------------------------------

    def value(self, view: View, value: Record, extra: dict[str, Any] | None = None) -> Record:
        """The row of a value and all that it owns."""
        key = self.key_of(view, value, True)
        row = {view.key: key} | (extra or {})
        self._columns(view, view.fields, "", value, row, key)
        if view.version_field:
            self._version(view, value, row, key, insert=True)
        self.put(view.table, view.key, row)
        for f, x in view.fields.items():
            if isinstance(x, Child):
                self._collection(view, f, x, value, key)
        return value

    def _columns(self, view: View, fields: dict[str, Field], prefix: str, value: dict[str, Any], row: dict[str, Any], key: Any) -> None:
        for f, x in fields.items():
            if isinstance(x, Column):
                if not x.computed and f in value:
                    v = value[f]
                    row[prefix + (x.column or f)] = json.dumps(v) if x.json and v is not None and not isinstance(v, str) else v
            elif isinstance(x, Embed) and isinstance(x.shape, Embedded):
                self._columns(view, x.shape.fields, prefix + x.prefix, value.get(f) or {}, row, key)
            elif isinstance(x, Embed):
                self._union(view, f, x, prefix + x.prefix, value.get(f), row, key)
            elif isinstance(x, ToOne):
                if x.graph and self.graph_keys is not None and value.get(f) is not None:
                    row[x.fk] = self.graph_keys[value[f]]
                    continue
                if x.graph and value.get(f) is not None and not isinstance(value.get(f), (int, str)):
                    raise WriteError(view.name, f, "the field points into a graph: use save_graph")
                if f in value:
                    target, got = view.target(x), value[f]
                    key_of = got if got is None or isinstance(got, (int, str)) else got.get(target.key_field)
                    if got is not None and key_of is None:
                        raise WriteError(view.name, f, "a reference to a value without a key")
                    row[x.fk] = key_of

    def _union(self, view: View, f: str, x: Embed, prefix: str, value: Any, row: dict[str, Any], key: Any) -> None:
        shape: Sum = x.shape
        if value is None:
            return
        chosen = next((v for v in shape.variants if v.name == value.get("$variant", value.get("$tag")) or v.tag == value.get("$tag")), None)
        if chosen is None:
            raise WriteError(view.name, f, f"no variant {value.get('$tag')!r}")
        row[prefix + shape.tag] = chosen.tag
        for v in shape.variants:
            if shape.table_per_variant:
                if not v.fields:
                    continue
                if v is chosen:
                    own = {v.key: key}
                    self._columns(view, v.fields, "", value, own, key)
                    self.put(v.table, v.key, own)
                    for g, y in v.fields.items():
                        if isinstance(y, Child):
                            self._collection(view, g, y, value, key)
                else:
                    self._remove_owned(view, v.fields, [key])
                    self.dropped.setdefault(v.table, []).append((v.key, [key], None, []))
            else:
                empty: dict[str, Any] = {}
                self._columns(view, v.fields, prefix, value if v is chosen else dict.fromkeys(v.fields), empty, key)
                for c, y in empty.items():
                    if v is chosen or c not in row:
                        row[c] = y

    def _collection(self, view: View, f: str, x: Child, value: Record, key: Any) -> None:
        if f not in value:
            return
        target, got = view.target(x), value[f]
        if x.graph and self.graph_keys is not None:
            keys = [self.graph_keys[r] for r in got]
            if x.through:
                self._links(view, f, x, key, keys)
                return
            for place, k in enumerate(keys):
                self.put(target.table, target.key, {target.key: k, x.fk: key} | ({x.index: place} if x.index else {}))
            self.nulls.setdefault(target.table, []).append((x.fk, target.key, [key], keys))
            return
        if x.graph:
            raise WriteError(view.name, f, "the field points into a graph: use save_graph")
        items = list(got.items()) if x.key else list(enumerate(got))
        if x.through:
            self._links(view, f, x, key, [e if isinstance(e, (int, str)) else e.get(target.key_field) for _, e in items])
            return
        kept = []
        for place, e in items:
            extra = {x.fk: key} | ({x.index: place} if x.index else {}) | ({x.key: place} if x.key else {})
            e = e if isinstance(e, Record) else Record(e)
            self.value(target, e, extra)
            kept.append(e[target.key_field])
            if x.key or isinstance(got, list):
                got[place] = e
        self._gone(target, x.fk, [key], kept)

    def _links(self, view: View, f: str, x: Child, key: Any, keys: list[Any]) -> None:
        if any(k is None for k in keys):
            raise WriteError(view.name, f, "a link to a value without a key")
        self.dropped.setdefault(x.through, []).append((x.fk, [key], None, []))
        self.links.setdefault(x.through, []).extend({x.fk: key, x.target: k} | ({x.index: i} if x.index else {}) for i, k in enumerate(keys))

    def _gone(self, target: View, fk: str, parents: list[Any], kept: list[Any]) -> None:
        """Elements of the parents that aren't kept go, with what they own; all of one collection's together."""
        if target.table in self.before.made:
            _, all_parents, all_kept = self.gone.setdefault((target.name, fk), (target, [], []))
            all_parents.extend(parents)
            all_kept.extend(kept)

    def _cascade(self) -> None:
        """What the elements that go own goes too, level by level: one query for each level."""
        while self.gone:
            level, self.gone = self.gone, {}
            for (_, fk), (target, parents, kept) in level.items():
                if _owns(target):
                    t = among(self.table(target.table), fk, parents)
                    keys = [r[0] for r in among(t, target.key, kept, False).select(quote(target.key)).collect()]
                    if keys:
                        self._remove_owned(target, target.fields, keys)
                self.dropped.setdefault(target.table, []).append((fk, parents, target.key, kept))

    def remove(self, view: View, keys: list[Any]) -> None:
        self._remove_owned(view, view.fields, keys)
        self.dropped.setdefault(view.table, []).append((view.key, keys, None, []))

    def _remove_owned(self, view: View, fields: dict[str, Field], keys: list[Any]) -> None:
        for x in fields.values():
            if isinstance(x, Child) and x.through:
                self.dropped.setdefault(x.through, []).append((x.fk, keys, None, []))
            elif isinstance(x, Child) and not x.graph:
                self._gone(view.target(x), x.fk, keys, [])
            elif isinstance(x, Embed) and isinstance(x.shape, Sum) and x.shape.table_per_variant:
                for v in x.shape.variants:
                    if v.fields:
                        self._remove_owned(view, v.fields, keys)
                        self.dropped.setdefault(v.table, []).append((v.key, keys, None, []))

    def _version(self, view: View, value: Record, row: dict[str, Any], key: Any, insert: bool) -> None:
        f = view.version_field
        column = view.fields[f].column or f
        self.versions.append((view, column, key, value.get(f), insert))
        value[f] = row[column] = (value.get(f) or 0) + 1

    # Changes --------------------------------------------------------------------------------------------------------

    def changes(self, view: View, before: Record, after: Record, extra: dict[str, Any] | None = None, root: bool = True) -> Record:
        f = view.key_field
        if f is None or before.get(f) is None or before.get(f) != after.get(f):
            raise WriteError(view.name, f or "", "the two values need the same key")
        key = after[f]
        old: dict[str, Any] = {view.key: key}
        new: dict[str, Any] = {view.key: key} | (extra or {})
        quiet = Write.__new__(Write)  # only to read the old row's columns
        quiet.__dict__.update(self.__dict__ | {"rows": {}, "dropped": {}, "links": {}, "versions": [], "gone": {}})
        quiet._columns(view, view.fields, "", before, old, key)
        probe = Write.__new__(Write)
        probe.__dict__.update(self.__dict__ | {"rows": {}, "dropped": {}, "links": {}, "versions": [], "gone": {}})
        probe._columns(view, view.fields, "", after, new, key)
        changed = {c: v for c, v in new.items() if c == view.key or c not in old or old[c] != v}
        for name in ("rows", "dropped", "links"):  # variant tables
            mine, theirs = getattr(self, name), getattr(probe, name)
            if str(theirs) != str(getattr(quiet, name)):
                for k, v in theirs.items():
                    mine.setdefault(k, []).extend(v)
        if probe.gone and str(probe.gone) != str(quiet.gone):
            for target, parents, kept in probe.gone.values():
                fk = next(f for (n, f), x in probe.gone.items() if x[0] is target and x[1] is parents)
                self._gone(target, fk, parents, kept)
        if view.version_field:
            changed.pop(view.fields[view.version_field].column or view.version_field, None)
        if len(changed) > 1:
            if view.version_field:
                self._version(view, after, changed, key, insert=False)
            self.put(view.table, view.key, changed)
        for g, x in view.fields.items():
            if isinstance(x, Child) and g in after:
                self._collection_changes(view, g, x, before, after, key)
        return after

    def _collection_changes(self, view: View, g: str, x: Child, before: Record, after: Record, key: Any) -> None:
        target = view.target(x)
        was, now = before.get(g) or ({} if x.key else []), after[g]
        key_of = lambda e: e if isinstance(e, (int, str)) else e.get(target.key_field)
        if x.through:
            if [key_of(e) for e in was] != [key_of(e) for e in now]:
                self._links(view, g, x, key, [key_of(e) for e in now])
            return
        old = {key_of(e): (p, Record(e)) for p, e in (was.items() if x.key else enumerate(was))}
        kept = []
        for place, e in list(now.items() if x.key else enumerate(now)):
            e = now[place] = e if isinstance(e, Record) else Record(e)
            place_row = ({x.index: place} if x.index else {}) | ({x.key: place} if x.key else {})
            if key_of(e) is not None and key_of(e) in old:
                moved = place_row if old[key_of(e)][0] != place else {}
                self.changes(target, old[key_of(e)][1], e, moved, False)
            else:
                self.value(target, e, {x.fk: key} | place_row)
            kept.append(key_of(e))
        gone = [k for k in old if k not in kept]
        if gone:
            self.remove(target, gone)

    # Applying -------------------------------------------------------------------------------------------------------

    def commit(self) -> int:
        self._check_versions()
        self._cascade()
        out: dict[str, DataFrame] = {}
        names = {t for t, _, _ in self.rows} | set(self.links) | set(self.dropped) | set(self.nulls)
        for name in sorted(names):
            df = self.table(name)
            for (column, key), (values, kept) in _together(self.dropped.get(name, [])).items():
                df = without(df, column, values, key, kept)
            for (column, key), (parents, kept) in _together([(c, p, k, e) for c, k, p, e in self.nulls.get(name, [])]).items():
                loose = among(df, column, parents)
                loose = among(loose, key, kept, False).withColumn(column, F.lit(None).cast(df.schema[column].dataType))
                df = without(df, column, parents, key, kept).unionByName(loose)
            for (table, key, columns), rows in self.rows.items():
                if table == name:
                    last = {r[key]: r for r in rows}
                    df = merge(df, self._frame(df, columns, list(last.values()), name), [key])
            if name in self.links:
                columns = tuple(self.links[name][0]) if self.links[name] else ()
                if columns:
                    df = df.unionByName(self._frame(df, columns, self.links[name], name), allowMissingColumns=True)
            out[name] = df
        return self.store.commit(out, self.base) if out else self.base

    def _frame(self, like: DataFrame, columns: tuple[str, ...], rows: list[dict[str, Any]], table: str) -> DataFrame:
        if missing := [c for c in columns if c not in like.columns]:
            raise WriteError("", table, f"the table has no column {missing[0]}")
        schema = T.StructType([T.StructField(c, like.schema[c].dataType) for c in columns])
        try:
            return self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)
        except Exception as e:
            raise WriteError("", table, f"a value doesn't fit its column: {e}") from e

    def _check_versions(self) -> None:
        """Rows must have the versions that the values have; a new row must have no row yet, or (changes) must have one."""
        for view in {v for v, *_ in self.versions}:
            mine = [(k, v, i) for w, _, k, v, i in self.versions if w is view]
            column = next(c for w, c, *_ in self.versions if w is view)
            t = self.table(view.table)
            found = {r[0]: r[1] for r in among(t, view.key, [k for k, _, _ in mine]).select(quote(view.key), quote(column)).collect()}
            for k, v, insert in mine:
                if (k in found and found[k] != v) or (k not in found and not insert):
                    raise Conflict(view.name, "", f"the row with key {k} has another version in the store than the value, or is gone")


def _owns(view: View) -> bool:
    return any(isinstance(x, Child) or (isinstance(x, Embed) and isinstance(x.shape, Sum) and x.shape.table_per_variant) for x in view.fields.values())


def save_frame(store: Store, view: View, nested: DataFrame) -> int:
    """The set-based form for values that are rows: nested, as ``Load.frame`` gives them, of a view with keys and without unions.

    Every level is exploded to rows of its table on the executors; nothing passes through the driver. Embedded values and
    maps are written too; unions, graph references and fields of all levels raise WriteError, and nothing is written.
    """
    base = store.version()
    tables, out = store.at_version(base), {}
    _save_level(view, nested, {}, tables, out)
    return store.commit(out, base)


def _save_level(view: View, rows: DataFrame, extra: dict[str, str], tables: Tables, out: dict[str, DataFrame]) -> None:
    columns = _flat_columns(view, view.fields, rows.schema, "", "")
    columns += [F.col(f"{quote(f)}.{quote(view.target(x).key_field)}").alias(x.fk) for f, x in view.fields.items() if isinstance(x, ToOne) and f in rows.columns]
    own = rows.select(*columns).columns  # a field of such a column goes first, as in Write
    columns += [F.col(quote(c)).alias(name) for name, c in extra.items() if name not in own]
    old, new = out.get(view.table, tables.table(view.table)), rows.select(*columns)
    if missing := [c for c in new.columns if c not in old.columns]:
        raise WriteError(view.name, view.table, f"the table has no column {missing[0]}")
    out[view.table] = merge(old, new, [view.key])
    key = view.key_field
    for f, x in view.fields.items():
        if not isinstance(x, Child) or f not in rows.columns:
            continue
        target = view.target(x)
        each = F.explode(F.col(quote(f))) if x.key else F.posexplode(F.col(quote(f)))
        e = rows.select(F.col(quote(key)).alias("$fk"), each.alias("$at", "$e"))
        parents = rows.select(F.col(quote(key)).alias("_p"))
        if x.through:
            links = out.get(x.through, tables.table(x.through))
            kept = links.join(parents, links[quote(x.fk)] == F.col("_p"), "left_anti")
            new = e.select(F.col("`$fk`").alias(x.fk), F.col(f"`$e`.{quote(target.key_field)}").alias(x.target), *([F.col("`$at`").alias(x.index)] if x.index else []))
            out[x.through] = kept.unionByName(new.select(*[F.col(quote(s.name)).cast(s.dataType).alias(s.name) for s in links.schema if s.name in new.columns]), allowMissingColumns=True)
            continue
        child = out.get(target.table, tables.table(target.table))
        same = [g for g, y in view.fields.items() if isinstance(y, Child) and not y.through and g in rows.columns and (view.target(y).table, y.fk) == (target.table, x.fk)]
        lists = [F.map_values(quote(g)) if view.fields[g].key else F.col(quote(g)) for g in same]  # what one collection of the rows holds, another doesn't remove
        keys = rows.select(F.explode(F.concat(*[F.coalesce(F.transform(v, lambda y: y[target.key_field]), F.array()) for v in lists])).alias("_k"))
        gone = child.join(parents, child[quote(x.fk)] == F.col("_p"), "left_semi").join(keys, F.col(quote(target.key)) == F.col("_k"), "left_anti").select(F.col(quote(target.key)).alias("_g"))
        out[target.table] = child.join(gone, child[quote(target.key)] == F.col("_g"), "left_anti")
        inner = e.select("`$e`.*", "`$fk`", "`$at`")
        _save_level(target, inner, {x.fk: "$fk"} | ({x.index: "$at"} if x.index else {}) | ({x.key: "$at"} if x.key else {}), tables, out)


def _flat_columns(view: View, fields: dict[str, Field], schema: T.StructType, at: str, prefix: str) -> list[SparkColumn]:
    """The columns of a level's fields; embedded values are flattened with their prefix."""
    out = []
    for f, x in fields.items():
        if f not in schema.names:
            continue
        if isinstance(x, (ToOne, Child)) and (x.graph or x.recursive):
            raise WriteError(view.name, f, "save_frame writes no graph references and no fields of all levels")
        path = f"{at}{quote(f)}"
        if isinstance(x, Column) and not x.computed:
            out.append(F.col(path).alias(prefix + (x.column or f)))
        elif isinstance(x, Embed) and isinstance(x.shape, Embedded):
            out += _flat_columns(view, x.shape.fields, schema[f].dataType, f"{path}.", prefix + x.prefix)
        elif isinstance(x, Embed):
            raise WriteError(view.name, f, "save_frame writes no unions")
    return out


def with_row_keys(df: DataFrame, key: str, start: int) -> DataFrame:
    """Keys for rows that have none: start, start + 1, ... in a stable order, numbered by ranges of the rows' hash."""
    part = df.withColumn("_h", F.xxhash64(*df.columns)).repartitionByRange("_h").withColumn("_p", F.spark_partition_id())
    sizes = part.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_s", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_p", "_s")
    inside = Window.partitionBy("_p").orderBy("_h")
    numbered = part.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(starts), "_p")
    return numbered.withColumn(key, F.col("_s") + F.col("_n") - 1 + F.lit(start)).drop("_h", "_p", "_n", "_s")
