"""Few-shot embedding analytics and corpus curation on Spark DataFrames."""
