"""Spark-native analytics for collections of periodic crystal structures."""
