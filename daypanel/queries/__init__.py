"""Registered queries: each runs an operator on the driver tables and, where SQL can say it, has SQL to compare with."""

from daypanel.queries import errors, models, panels, risks, sequences, shared, transforms  # noqa: F401
from daypanel.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
