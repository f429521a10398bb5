"""kodagraf: source-code repositories analysed as DataFrames on Spark."""

__version__ = "0.1.0"
