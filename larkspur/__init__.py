"""A relational engine on Spark DataFrames: typed expressions, operators, a small SQL, a catalog."""
