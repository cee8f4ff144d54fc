"""Loomwork: a Spark-native data workbench."""
