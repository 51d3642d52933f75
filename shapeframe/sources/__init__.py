"""Where rows come from and go to: tables, user SQL, versioned stores, schema snapshots."""

from .tables import Tables

__all__ = ["Tables"]
