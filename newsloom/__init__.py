"""newsloom: a PySpark-native analytics engine for dated text corpora."""
