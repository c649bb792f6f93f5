"""splitlens: experiment and behaviour analytics expressed as Spark DataFrame / SQL plans.

Every public function takes and returns a ``pyspark.sql.DataFrame``; nothing is
collected to the driver except bounded scalars (a handful of statistics).
"""

from splitlens.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
