"""Column, group-by, key-lookup and encoding operators for flat typed tables on Spark."""
