"""Views over the parquet tables and the registered queries built on them."""
