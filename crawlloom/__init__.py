"""Website crawl analytics as DataFrame transformations on PySpark."""
