"""quillspark: Spark-native analytics for traces, evaluation records and model metadata."""
