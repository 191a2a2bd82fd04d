"""Curation of discussion-forum data as PySpark jobs.

Every public function takes and returns DataFrames (or Columns) and takes the
clock as an explicit ``as_of`` argument; nothing here calls ``now()``.
"""

from threadspark.session import build_session

__all__ = ["build_session"]
