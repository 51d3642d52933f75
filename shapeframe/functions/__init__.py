"""Conditions and selections."""

from .filters import Condition, Nested, col
from .selection import Selection

__all__ = ["Condition", "Nested", "Selection", "col"]
