"""sessionsift: prune and compress assistant transcripts with Spark.

Every operator is a ``DataFrame -> DataFrame`` function keyed by
``session_id`` so one job handles any number of sessions.
"""

from sessionsift.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
