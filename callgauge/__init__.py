"""Event analytics on Spark: DataFrame-to-DataFrame operators for dated texts,
quarterly statements and daily prices."""
