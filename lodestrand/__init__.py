"""Change-evidence analytics and corpus operators written as PySpark jobs."""
