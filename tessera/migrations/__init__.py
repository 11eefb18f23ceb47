"""Ordered, checksummed, reversible changes of a store, and the difference between schemas."""

from .diff import Change, diff_schemas, write_migration  # noqa: F401
from .runner import Migration, Runner, load_directory  # noqa: F401
