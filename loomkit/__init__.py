"""loomkit: DataFrame-in / DataFrame-out operators for the data work around ML.

Every operator takes Spark DataFrames and returns Spark DataFrames (or a
``pyspark.ml`` pipeline).  Planning is left to Catalyst; Python only decides
which declarative plan to build.
"""

from loomkit.session import build_session, checkpoint_dir, load_table  # noqa: F401

__all__ = ["build_session", "checkpoint_dir", "load_table"]
