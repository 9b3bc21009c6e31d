"""A PySpark engine for financial time series and for training-data tables."""
