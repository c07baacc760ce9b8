"""graphloom: a knowledge-graph analytics engine written on Spark DataFrames."""
