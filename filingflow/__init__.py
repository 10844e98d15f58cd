"""filingflow: company-filing feed, registry, search and document condensation on Spark.

Every public function takes DataFrames (plus plain parameters) and returns a DataFrame, so
callers compose whole-table jobs; nothing iterates rows on the driver.
"""

from filingflow.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
