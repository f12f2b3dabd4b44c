"""seedloom: a PySpark-native engine for instruction-tuning corpora."""
