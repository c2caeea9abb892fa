"""weftgraph: build graphs from tables, propagate over them, cluster them, and score the result, on Spark DataFrames."""
