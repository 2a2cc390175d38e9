"""clipflow: score streams, clips, text-quality runs and corpus preparation on Spark DataFrames."""
