"""corpusmill: Spark-native operators over large corpora of short texts, their logs and their vectors."""
