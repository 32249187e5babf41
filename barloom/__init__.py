"""barloom: daily and minute price-bar analytics expressed as Spark DataFrame jobs."""
