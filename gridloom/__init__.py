"""Table recovery, review and corpus evaluation as Spark DataFrame operators."""
