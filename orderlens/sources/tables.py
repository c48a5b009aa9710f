"""The set of raw tables the order mart is built from."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from orderlens.schemas import INGEST_COL, KEEP_FIRST_KEYS, RAW_COLUMNS


@dataclass(frozen=True)
class RawTables:
    """Eight raw sources. Keep-first tables carry an ingest-position column."""

    orders: DataFrame
    customers: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    translation: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register_views(self, prefix: str = "raw_") -> None:
        """Expose every table to SQL as ``raw_<name>``."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)

    def validate(self) -> None:
        """Fail fast (no job runs) when a source lacks a column the pipeline reads."""
        for name, df in self.as_dict().items():
            have = set(df.columns)
            missing = [c for c in RAW_COLUMNS[name] if c not in have]
            if name in KEEP_FIRST_KEYS and INGEST_COL not in have:
                missing.append(INGEST_COL)
            if missing:
                raise ValueError(f"raw table {name!r} lacks columns {missing}")
