"""sinter - process-data analytics on Spark DataFrames.

Cleaning of messy sensor tables, ordered-series repair, time and seeded
splits, regime finding (k-means, grid DBSCAN), regressors with the regime
as a feature, inductive conformal intervals and error metrics, all written
as DataFrame / Spark ML jobs.
"""

from sinter.session import get_session, checkpoint_root, scratch_path

__all__ = ["get_session", "checkpoint_root", "scratch_path"]
__version__ = "0.1.0"
