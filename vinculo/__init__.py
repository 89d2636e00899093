"""Entity linkage and roster reconciliation on Spark DataFrames."""
