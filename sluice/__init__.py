"""sluice: training-data scheduling, grading and reporting as PySpark DataFrame plans."""
