"""Build the order mart from raw tables, check it, and publish it in a store (data folders and a manifest).

spark-submit jobs/build_mart.py --csv-dir s3://.../raw --out s3://.../mart [--partition-by-month]
"""

from __future__ import annotations

import argparse

from _common import add_source_args, raw_tables, session


def main() -> None:
    p = argparse.ArgumentParser()
    add_source_args(p)
    p.add_argument("--out", required=True)
    p.add_argument("--partition-by-month", action="store_true",
                   help="partition the output by purchase_period (large data only)")
    args = p.parse_args()
    spark = session("orderlens-build-mart")
    from orderlens.plans.dashboard import publish_mart

    raw, key = raw_tables(spark, args)
    publish_mart(raw, args.out, key, args.partition_by_month)


if __name__ == "__main__":
    main()
