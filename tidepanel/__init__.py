"""tidepanel: panel time-series analytics as lazy PySpark DataFrame operators."""
