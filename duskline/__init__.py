"""Traffic-stop analytics as plain PySpark DataFrame functions."""
