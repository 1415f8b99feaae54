"""Alert triage over tables of money transfers, on Spark DataFrames."""
