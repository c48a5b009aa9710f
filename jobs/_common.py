"""Shared argument handling for the spark-submit jobs."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


def session(app: str):
    """The cluster's session (spark-submit decides master and resources)."""
    from orderlens.config import get_session

    return get_session(master=os.environ.get("ORDERLENS_MASTER"), app_name=app)


def raw_tables(spark, args):
    """The raw tables and the identity of the files they come from."""
    from orderlens.plans.dashboard import fixture_key
    from orderlens.sources import csv_tables, fixture_tables
    from orderlens.sources.csv_tables import table_paths
    from orderlens.sources.mart_store import source_key

    if args.csv_dir:
        return csv_tables(spark, args.csv_dir), source_key(spark, *table_paths(args.csv_dir).values())
    return fixture_tables(spark, args.fixture_dir), fixture_key(spark, args.fixture_dir)


def add_source_args(p):
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("--csv-dir", help="folder with the eight raw CSV tables")
    g.add_argument("--fixture-dir", help="folder with the TPC-H-style Parquet test tables")
