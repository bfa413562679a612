"""PySpark-native analytics over sensor time series and text corpora."""
