"""dustloom: DataFrame operators for atmospheric observation data on Spark."""
