"""Where tables come from: read-only Parquet folders, the snapshot store, and their inspection."""

from .directory import ParquetDirectory  # noqa: F401
from .store import Store  # noqa: F401
