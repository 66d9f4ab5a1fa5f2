"""Column expressions. Everything here is built-in Spark SQL; there are no UDFs."""
