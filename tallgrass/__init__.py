"""A DataFrame analytics engine written on Spark plans."""
