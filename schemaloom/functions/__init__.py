"""Column builders: names, similarities and values. All are built-in expressions, none is a UDF."""
