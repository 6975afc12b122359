"""veritab: verified analysis of tables on Spark."""
