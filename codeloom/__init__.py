"""codeloom: Spark-native data work for qualitative (Grounded Theory) text coding."""
