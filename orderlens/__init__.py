"""orderlens: e-commerce order analytics and late-delivery modelling on Spark.

Layers (each a set of ``DataFrame -> DataFrame`` functions, lazy until a sink):

* ``sources``   raw tables (CSV catalog, test-table mapping) and the mart store
* ``functions`` column expressions and distributed aggregates (exact median, ...)
* ``operators`` order mart, metric tables, findings, data-quality checks
* ``ml``        feature pipeline, stratified split, training, evaluation, scoring
* ``plans``     composed jobs: dashboard view, training run, batch scoring
* ``streaming`` incremental scoring of arriving orders
"""

from orderlens.config import get_session, checkpoint_root

__all__ = ["get_session", "checkpoint_root"]
__version__ = "0.1.0"
