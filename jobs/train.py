"""Train the late-delivery forest on a mart, evaluate on the held-out split, save model and metrics.

spark-submit jobs/train.py --mart s3://.../mart --model-out s3://.../model --metrics-out s3://.../metrics
"""

from __future__ import annotations

import argparse

from _common import session


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--mart", required=True)
    p.add_argument("--model-out", required=True)
    p.add_argument("--metrics-out", required=True)
    p.add_argument("--nodes-out", help="folder for the encoder and the forest's node table, for jobs/score.py --nodes")
    p.add_argument("--weights", choices=["global", "per-tree"], default="global",
                   help="class weights of the whole training set, or of each tree's own bootstrap sample (needs --nodes-out)")
    p.add_argument("--trees", type=int, default=200)
    p.add_argument("--depth", type=int, default=18)
    args = p.parse_args()
    spark = session("orderlens-train")
    from orderlens.ml.model import ForestParams
    from orderlens.plans.dashboard import open_mart
    from orderlens.ml.nodes import encoder_of, fit_per_tree, node_table, save_nodes
    from orderlens.plans.training import train_late_model, training_rows

    mart, params = open_mart(spark, args.mart), ForestParams(num_trees=args.trees, max_depth=args.depth)
    result = train_late_model(spark, mart, params, model_path=args.model_out, metrics_path=args.metrics_out)
    if args.nodes_out:
        save_nodes(*(fit_per_tree(training_rows(spark, mart), params) if args.weights == "per-tree"
                     else (encoder_of(result.model), node_table(result.model, spark))), args.nodes_out)


if __name__ == "__main__":
    main()
