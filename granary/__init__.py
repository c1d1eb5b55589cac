"""granary: content-corpus analytics and training-data preparation on PySpark."""
