"""Catalogs: where tables come from and go to."""

from nestql.sources.base import Catalog, MemoryCatalog, ParquetCatalog

__all__ = ["Catalog", "MemoryCatalog", "ParquetCatalog"]
