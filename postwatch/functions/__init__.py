"""Column functions.  All are native expressions; none is a Python UDF."""
