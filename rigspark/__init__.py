"""Multi-sensor geometry analytics and training-data preparation on PySpark."""
