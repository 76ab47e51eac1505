"""sieve: systematic literature screening as Spark DataFrame jobs.

Subpackages
-----------
functions   Column expressions (keyword queries, DOI, ranks, text cleanup, formats)
operators   DataFrame operators (screening, rank lookup, enrichment, abstracts,
            assessments, reports)
sources     readers and writers (bibliography XML, study specs, Parquet store, CSV)
plans       composed review runs and the derived input views used by the checks
streaming   incremental screening of newly arriving bibliography files
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
