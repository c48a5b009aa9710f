"""Write every dashboard table (KPIs, summaries, rankings, findings) for one filter pair.

spark-submit jobs/dashboard_report.py --mart s3://.../mart --out s3://.../report [--state SP] [--category x]
"""

from __future__ import annotations

import argparse

from _common import session


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--mart", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--state", default=None)
    p.add_argument("--category", default=None)
    args = p.parse_args()
    spark = session("orderlens-dashboard")
    from orderlens.plans.dashboard import DashboardView, open_mart

    DashboardView(open_mart(spark, args.mart), args.state, args.category).write(args.out)


if __name__ == "__main__":
    main()
