"""Declaring views: what an aggregate looks like, and where its parts are stored.

    Song = View("Song", "song", {"id": Column(BIGINT), "title": Column(STRING)})
    Playlist = View("Playlist", "playlist", {
        "id": Column(BIGINT),
        "songs": Child(Song, fk="playlist_id", through="playlist_song", target="song_id", index="seq"),
    })

A related view is given itself, as a function that returns it (for cycles), or as ``"self"``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .errors import ShapeError


@dataclass(frozen=True)
class ValueType:
    """A scalar, whether it may be NULL, and whether a column holds a list of it."""

    scalar: str
    nullable: bool = False
    list: bool = False


BOOLEAN, INT, BIGINT, FLOAT, STRING, UUID, DATE, TIME, DATETIME, NAIVE_DATETIME, DECIMAL, JSON, BYTES = map(
    ValueType, ("Boolean", "Int", "BigInt", "Float", "String", "Uuid", "Date", "Time", "DateTime", "NaiveDateTime", "Decimal", "Json", "Bytes")
)

#: Spark types (simple strings, or their start) that each scalar can be read from.
ACCEPTS: dict[str, tuple[str, ...]] = {
    "Boolean": ("boolean",),
    "Int": ("tinyint", "smallint", "int"),
    "BigInt": ("tinyint", "smallint", "int", "bigint", "decimal"),
    "Float": ("float", "double"),
    "String": ("string", "varchar", "char"),
    "Uuid": ("string",),
    "Date": ("date",),
    "Time": ("time",),
    "DateTime": ("timestamp",),
    "NaiveDateTime": ("timestamp_ntz",),
    "Decimal": ("decimal",),
    "Json": ("string", "variant"),
    "Bytes": ("binary",),
}


def accepts(kind: ValueType, spark_type: str) -> bool:
    """Whether a column of the Spark type can fill the field."""
    if kind.list:
        return spark_type.startswith("array<") and accepts(replace(kind, list=False), spark_type[6:-1])
    known = ACCEPTS.get(kind.scalar)
    return known is None or spark_type.split("(")[0] in known


def optional(kind: ValueType) -> ValueType:
    return replace(kind, nullable=True)


def list_of(kind: ValueType) -> ValueType:
    return replace(kind, list=True)


@dataclass(frozen=True)
class Column:
    """A column of the view's table. ``computed`` values come from SQL only."""

    type: ValueType
    column: str | None = None
    json: bool = False
    version: bool = False
    generated: bool = False
    computed: bool = False


@dataclass(frozen=True)
class Embed:
    """A product or tagged union stored in columns of the same row (or, by its strategy, in tables of its variants)."""

    shape: Embedded | Sum
    prefix: str = ""


@dataclass(frozen=True)
class ToOne:
    """A reference by foreign key."""

    view: View | str | Callable[[], View]
    fk: str
    optional: bool = False
    depth: int | None = None
    recursive: bool = False
    graph: bool = False
    shared: bool = False


@dataclass(frozen=True)
class Child:
    """A collection: by foreign key, or through a link table; a list in order, a list by index, or a map by key."""

    view: View | str | Callable[[], View]
    fk: str
    order_by: str = ""
    through: str | None = None
    target: str | None = None
    index: str | None = None
    key: str | None = None
    depth: int | None = None
    recursive: bool = False
    graph: bool = False
    shared: bool = False


Field = Column | Embed | ToOne | Child


@dataclass(frozen=True)
class Embedded:
    name: str
    fields: dict[str, Field]

    def __post_init__(self):
        for f, x in self.fields.items():
            if isinstance(x, (ToOne, Child)):
                raise ShapeError(self.name, f, "an embedded shape holds no relationships")
            if isinstance(x, Column) and (x.version or x.generated or x.computed):
                raise ShapeError(self.name, f, "version, generated and computed belong to a view's own fields")


def generic(name: str, make: Callable[..., dict[str, Field]]) -> Callable[..., Embedded]:
    """A family of embedded shapes: one, named after its arguments, for each set of types."""
    made: dict[tuple[ValueType, ...], Embedded] = {}

    def of(*types: ValueType) -> Embedded:
        if types not in made:
            made[types] = Embedded(f"{name}<{', '.join(t.scalar for t in types)}>", make(*types))
        return made[types]

    return of


@dataclass(frozen=True)
class Variant:
    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    tag_value: str | None = None
    table: str | None = None
    key: str = "id"

    @property
    def tag(self) -> str:
        return self.tag_value if self.tag_value is not None else self.name


@dataclass(frozen=True)
class Sum:
    """A tagged union. Its variants are columns of the row, or (``table_per_variant``) rows of their own tables."""

    name: str
    tag: str
    variants: tuple[Variant, ...]
    table_per_variant: bool = False
    lenient: bool = False

    def __post_init__(self):
        if not self.tag:
            raise ShapeError(self.name, "", "a union needs a tag column")
        tags = [v.tag for v in self.variants]
        if len(set(tags)) != len(tags):
            raise ShapeError(self.name, "", "two variants have one tag value")
        for v in self.variants:
            for f, x in v.fields.items():
                if isinstance(x, (ToOne, Child)) and not self.table_per_variant:
                    raise ShapeError(self.name, f"{v.name}.{f}", "a variant stored as columns holds no relationships")
                if isinstance(x, (ToOne, Child)) and x.graph:
                    raise ShapeError(self.name, f"{v.name}.{f}", "a variant holds no graph references")
                if isinstance(x, Column) and x.computed:
                    raise ShapeError(self.name, f"{v.name}.{f}", "a variant holds no computed fields")
                if f.isdigit() and isinstance(x, Column) and not x.column:
                    raise ShapeError(self.name, f"{v.name}.{f}", "a tuple field names its column")
            if v.table and not self.table_per_variant:
                raise ShapeError(self.name, v.name, "a table belongs to the table_per_variant strategy")
            if self.table_per_variant and v.fields and not v.table:
                raise ShapeError(self.name, v.name, "a variant with data names its table")


@dataclass(frozen=True)
class View:
    """The shape of the values loaded from one table."""

    name: str
    table: str
    fields: dict[str, Field]
    key: str = "id"
    databases: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.table:
            raise ShapeError(self.name, "", "a view names its table")
        for f, x in self.fields.items():
            _check(self, f, x)

    def __hash__(self):
        return hash((self.name, self.table))

    def __eq__(self, other):
        return self is other

    def target(self, x: ToOne | Child) -> View:
        if isinstance(x.view, View):
            return x.view
        return self if x.view == "self" else x.view()

    @property
    def key_field(self) -> str | None:
        """The field that holds the key, if one does."""
        return next((f for f, x in self.fields.items() if isinstance(x, Column) and not x.computed and (x.column or f) == self.key), None)

    @property
    def version_field(self) -> str | None:
        return next((f for f, x in self.fields.items() if isinstance(x, Column) and x.version), None)

    def has_graph_edges(self, seen: frozenset[View] = frozenset()) -> bool:
        """Whether a graph reference is in the view or in what it owns or references."""
        if self in seen:
            return False
        for x in relations(self.fields):
            if x.graph or self.target(x).has_graph_edges(seen | {self}):
                return True
        return False


def relations(fields: dict[str, Field]) -> list[ToOne | Child]:
    return [x for x in fields.values() if isinstance(x, (ToOne, Child))]


def _check(view: View, f: str, x: Field) -> None:
    def no(message: str):
        raise ShapeError(view.name, f, message)

    if isinstance(x, Column):
        if x.generated and ((x.column or f) != view.key or x.type.scalar not in ("Int", "BigInt") or not x.type.nullable):
            no("generated belongs to a key that is an optional integer")
        if x.version and x.type.scalar not in ("Int", "BigInt"):
            no("a version is an integer column")
        if x.computed and (x.column or x.json or x.version or x.generated):
            no("a computed field takes no other attribute")
        return
    if isinstance(x, Embed):
        return
    if not x.fk:
        no("a relationship names its foreign key")
    if x.depth is not None and x.depth < 1:
        no("depth is at least 1")
    if x.graph and (x.depth or x.recursive):
        no("a graph field takes no depth or recursion")
    if isinstance(x, ToOne):
        if (x.depth or x.recursive) and not x.optional:
            no("a recursive reference is optional")
        if x.depth and x.recursive:
            no("a reference followed to its end takes no depth")
        return
    if bool(x.through) != bool(x.target):
        no("through and target are given together")
    if x.index and x.key:
        no("an index belongs to a list, a key to a map")
    if x.graph and x.key:
        no("a map holds owned values")
    if x.recursive and x.through:
        no("a recursive collection has no link table")
    for part in filter(None, (p.strip() for p in x.order_by.split(","))):
        if len(part.split()) > 2 or (len(part.split()) == 2 and part.split()[1].lower() not in ("asc", "desc")):
            no(f"cannot read the order {part!r}")


def order_terms(order_by: str) -> list[tuple[str, bool]]:
    """(column, descending) of ``a, b desc``."""
    out = []
    for part in filter(None, (p.strip() for p in order_by.split(","))):
        name, *way = part.split()
        out.append((name, bool(way) and way[0].lower() == "desc"))
    return out
