"""batchloom: reproducible minibatch sampling and analytics on Spark DataFrames."""
