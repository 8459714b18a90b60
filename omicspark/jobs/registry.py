"""All registered queries of the library and the SQL that gives the same rows."""

import importlib

from omicspark.jobs.query import ORACLES, QUERIES

for _name in ("popgen", "relatedness", "genetics", "interpretation", "omics", "cohorts", "numeric", "reports", "scalar"):
    importlib.import_module(f"omicspark.jobs.{_name}")

__all__ = ["ORACLES", "QUERIES"]
