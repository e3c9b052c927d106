"""Log analytics on Spark: ingest, search, catalogue, freshness and capacity jobs.

Every public function takes and returns DataFrames or Columns, so the pieces
compose with ordinary Spark code.
"""
