"""regionhour: region-by-hour event analytics on Spark.

Every public function takes and returns DataFrames (or Columns) and stays lazy;
nothing is collected to the driver and no group is gathered in one task.
"""

from regionhour.session import build_session

__all__ = ["build_session"]
