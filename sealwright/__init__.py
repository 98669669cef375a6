"""Bulk inspection of evidence bundles as Spark jobs.

Every operator takes DataFrames keyed by a scope column (bundle, snapshot,
graph, run, project) and returns DataFrames.  Faults come back as rows, see
:mod:`sealwright.operators.findings`.
"""

__version__ = "0.1.0"
