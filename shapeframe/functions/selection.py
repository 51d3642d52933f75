"""Selections: which fields of a view to load."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import PlanError

_TOKEN = re.compile(r"[\s,]+|([{}])|([A-Za-z_$][\w$]*|\d+)|(.)", re.S)


@dataclass
class Selection:
    """A tree of field names."""

    fields_: dict[str, Selection] = field(default_factory=dict)

    def field(self, name: str) -> Selection:
        self.fields_.setdefault(name, Selection())
        return self

    def nested(self, name: str, inner: Selection) -> Selection:
        self.fields_[name] = self.fields_.get(name, Selection()).merge(inner)
        return self

    def merge(self, other: Selection) -> Selection:
        for name, inner in other.fields_.items():
            self.fields_[name] = self.fields_.get(name, Selection()).merge(inner)
        return self

    def get(self, name: str) -> Selection | None:
        return self.fields_.get(name)

    def is_empty(self) -> bool:
        return not self.fields_

    def fields(self) -> list[str]:
        return list(self.fields_)

    @staticmethod
    def parse(text: str) -> Selection:
        """Reads ``name assignee { name } children { name }``; commas are white space, outer braces optional."""
        tokens = []
        for m in _TOKEN.finditer(text):
            if m[3]:
                raise PlanError("", "", f"cannot read {m[3]!r} in a selection")
            if m[1] or m[2]:
                tokens.append(m[1] or m[2])
        if tokens[:1] == ["{"] and tokens[-1:] == ["}"]:
            tokens = tokens[1:-1]
        stack: list[Selection] = [Selection()]
        last = None
        for t in tokens:
            if t == "{":
                if last is None:
                    raise PlanError("", "", "a selection opens without a field")
                stack.append(stack[-1].fields_[last])
                last = None
            elif t == "}":
                if len(stack) == 1:
                    raise PlanError("", "", "a selection closes twice")
                stack.pop()
                last = None
            else:
                stack[-1].field(t)
                last = t
        if len(stack) > 1:
            raise PlanError("", "", "a selection is not closed")
        return stack[0]

    def __str__(self) -> str:
        return " ".join(f"{n} {{ {s} }}" if s.fields_ else n for n, s in self.fields_.items())
