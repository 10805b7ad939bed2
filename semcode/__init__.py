"""semcode: qualitative content analysis (embedding-similarity coding) on Spark.

Every operator takes and returns keyed DataFrames and stays lazy; the only
values that reach the driver are bounded by the number of classes, thresholds,
iterations or clusters, or by an explicit, checked broadcast budget.
"""

from semcode.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
