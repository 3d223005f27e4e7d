"""Assessment analytics on Spark DataFrames: grading, gradebooks, rankings and quiz documents."""
