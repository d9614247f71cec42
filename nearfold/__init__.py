"""nearfold: similarity search over feature vectors and irregular time series on Spark."""
