"""Spark-native analytics for daily store x product demand panels."""
