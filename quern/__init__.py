"""quern: a PySpark-native engine for code graphs, agent session logs and usage data."""
