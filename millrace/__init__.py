"""A recipe-driven data-cleaning engine on PySpark."""
