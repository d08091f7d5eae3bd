"""Functions on SQL text: dialects, lexical rewriting to Spark SQL."""
