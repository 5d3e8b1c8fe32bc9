"""mlframe: tabular feature engineering and linear-model training on Spark DataFrames."""

__version__ = "0.1.0"
