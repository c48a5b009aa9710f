"""Score a table of orders with a saved model; invalid inputs go to a reject table.

spark-submit jobs/score.py --model s3://.../model --orders s3://.../new_orders --out s3://.../scores
"""

from __future__ import annotations

import argparse

from _common import session


def main() -> None:
    p = argparse.ArgumentParser()
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("--model", help="a saved pipeline; the driver loads all its trees")
    g.add_argument("--nodes", help="a folder of jobs/train.py --nodes-out; trees are read in groups of bounded size")
    p.add_argument("--orders", required=True, help="Parquet with order_id and the eight model features")
    p.add_argument("--out", required=True)
    p.add_argument("--rejects", default=None)
    args = p.parse_args()
    spark = session("orderlens-score")
    from orderlens.ml.model import feature_frame, load_model
    from orderlens.ml.nodes import load_nodes, score_with_nodes
    from orderlens.ml.score import score_orders, split_valid

    valid, rejects = split_valid(spark.read.parquet(args.orders))
    if args.model:
        scored = score_orders(load_model(args.model), valid)
    else:
        scored = score_with_nodes(*load_nodes(spark, args.nodes), feature_frame(valid))
    scored.write.mode("overwrite").parquet(args.out)
    if args.rejects:
        rejects.write.mode("overwrite").parquet(args.rejects)


if __name__ == "__main__":
    main()
