"""An analytics engine on PySpark: queries, operators and functions as logical plans."""
