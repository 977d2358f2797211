"""marlstone: a PySpark-native engine for month-stamped question and answer corpora."""
