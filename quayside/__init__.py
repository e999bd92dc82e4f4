"""Quayside: operate a managed data lake with Spark DataFrames.

Catalog, work log, partitions, schemas and grants are tables; every operator
takes DataFrames and returns a DataFrame, and takes the evaluation time as an
argument so that a run can be repeated.
"""

from quayside.session import new_session, stable, tune, work_dir

__all__ = ["new_session", "stable", "tune", "work_dir"]
