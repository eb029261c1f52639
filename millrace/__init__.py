"""millrace: a Spark-native analytics library made of plain functions over DataFrames."""
