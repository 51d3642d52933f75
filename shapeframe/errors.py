"""One exception per way in which a load, a check or a write can fail. Messages name the view and the path."""

from __future__ import annotations


class ShapeframeError(Exception):
    """Base of all errors; ``view`` and ``path`` say where."""

    def __init__(self, view: str = "", path: str = "", message: str = ""):
        self.view, self.path, self.message = view, path, message
        super().__init__(": ".join(x for x in (view, f"`{path}`" if path else "", message) if x))


class ShapeError(ShapeframeError):
    """A declaration that no view can have."""


class PlanError(ShapeframeError):
    """A cycle without depth, an unsupported recursion or embedding, an unknown selected field."""


class QueryError(ShapeframeError):
    """A query failed; carries the SQL."""


class DecodeError(ShapeframeError):
    """NULL, or a value of another type, in a field that cannot hold it."""


class MissingReference(ShapeframeError):
    pass


class NullTag(ShapeframeError):
    pass


class UnknownTag(ShapeframeError):
    pass


class OtherVariantColumn(ShapeframeError):
    pass


class MissingVariant(ShapeframeError):
    pass


class ListIndex(ShapeframeError):
    pass


class DuplicateMapKey(ShapeframeError):
    pass


class Cycle(ShapeframeError):
    pass


class UnloadedReference(ShapeframeError):
    pass


class GraphRequired(ShapeframeError):
    pass


class MixedKeys(ShapeframeError):
    pass


class NotFound(ShapeframeError):
    pass


class TooManyRows(ShapeframeError):
    def __init__(self, view: str, count: int):
        self.count = count
        super().__init__(view, "", f"expected one row, found {count}")


class NestedArguments(ShapeframeError):
    pass


class SelectionWithoutJson(ShapeframeError):
    pass


class JsonError(ShapeframeError):
    pass


class ColumnNotSelected(ShapeframeError):
    pass


class KeysRequired(ShapeframeError):
    pass


class ParamsError(ShapeframeError):
    pass


class Invalid(ShapeframeError):
    """A registry whose checks found errors; carries the report."""

    def __init__(self, report):
        self.report = report
        super().__init__("", "", f"the views do not match the tables\n{report}")


class CheckError(ShapeframeError):
    pass


class NotRegistered(ShapeframeError):
    pass


class WrongBackend(ShapeframeError):
    pass


class ManifestBackend(ShapeframeError):
    pass


class ConnectionError(ShapeframeError):  # noqa: A001 the name users look for
    pass


class WriteError(ShapeframeError):
    pass


class Conflict(ShapeframeError):
    """The row's version, or the store's head, moved since it was read."""


#: Errors that a running Spark job can raise, by the code in its message.
IN_JOBS = {e.__name__: e for e in (DecodeError, MissingReference, NullTag, UnknownTag, OtherVariantColumn, MissingVariant, ListIndex, DuplicateMapKey, Cycle)}


def translated(error: Exception) -> Exception:
    """The error that a job's message stands for; the error itself if none."""
    text = str(error)
    if "DUPLICATED_MAP_KEY" in text:
        return DuplicateMapKey("", "", text.splitlines()[0])
    at = text.find("shapeframe|")
    if at < 0:
        return error
    _, code, view, path, detail = (text[at:].split("|end|", 1)[0].split("|") + [""] * 4)[:5]
    return IN_JOBS[code](view, path, detail) if code in IN_JOBS else error
