"""Retail star-schema analytics on PySpark: loaders, staged extracts, a decision-support
query library, dimension/fact refresh jobs and integrity checks."""
