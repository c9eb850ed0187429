"""quarry: filtered semantic retrieval and post analytics as Spark DataFrame operators.

Every public operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``).  Nothing is collected to the driver except bounded inputs:
a question table proven small by a width-capped ``limit`` fetch (larger ones
stay distributed in tiles), one count per cell, k-means centroids, and
configuration (thresholds, selections, models, tasks).
"""

from quarry.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
