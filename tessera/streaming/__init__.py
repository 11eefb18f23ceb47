"""Streams are no part of the statement model; a lowered stateless SELECT also runs on a streaming source.

``Database.frame`` on a provider that returns streaming DataFrames (``StreamDirectory``) gives a
streaming DataFrame; terminals that collect are refused by Spark there.
"""

from .directory import StreamDirectory  # noqa: F401
