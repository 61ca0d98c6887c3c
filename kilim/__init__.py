"""kilim: annotation and analysis of code-switched text on Spark DataFrames."""
