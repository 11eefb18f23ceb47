"""Python source for row classes, table objects and query functions."""

from .emit import check_module, query_module, store_module, write_module  # noqa: F401
