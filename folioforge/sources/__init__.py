"""Reading tables and keeping intermediate ones."""

from folioforge.sources.tables import forget, keep, once, sharing, table

__all__ = ["forget", "keep", "once", "sharing", "table"]
