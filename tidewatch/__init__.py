"""Spark-native scoring of many time series, with corpus operators beside it in ``tidewatch.llm``."""
