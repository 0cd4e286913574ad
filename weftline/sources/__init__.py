"""Table sources."""

from weftline.sources.tables import TABLES, read_table

__all__ = ["TABLES", "read_table"]
