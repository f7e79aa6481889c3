"""The operators on the driver's tables, and the same results in SQL."""
