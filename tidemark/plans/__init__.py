"""Every query of the library on the test tables, with the DuckDB SQL that gives the same rows."""

from . import accounts, files, folds, listings, messages, queries, writes, kept  # noqa: F401, I001
from .registry import FOUND

__all__ = ["FOUND"]
