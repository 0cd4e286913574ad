"""Analytics queries over tables, written on the Spark DataFrame API."""
