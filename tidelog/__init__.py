"""Log-structured tables and corpus operators expressed as Spark DataFrame plans."""
