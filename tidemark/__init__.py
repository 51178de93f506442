"""tidemark: sentiment-to-market analytics expressed as PySpark DataFrame transforms."""
