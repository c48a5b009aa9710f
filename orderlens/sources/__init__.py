"""Raw sources (CSV catalog, test-table mapping) and the materialised mart store."""

from orderlens.sources.csv_tables import csv_tables, read_csv_table
from orderlens.sources.fixture import fixture_tables
from orderlens.sources.tables import RawTables

__all__ = ["RawTables", "csv_tables", "fixture_tables", "read_csv_table"]
