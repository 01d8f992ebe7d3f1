"""turnwise: conversation and agent-trajectory analytics on PySpark DataFrames."""

from turnwise.errors import AnalyticsError
from turnwise.session import configure, local_session

__all__ = ["AnalyticsError", "configure", "local_session"]
