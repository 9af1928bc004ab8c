"""urlspark: URL-threat features, selection, focal boosting and explanations on Spark DataFrames."""
