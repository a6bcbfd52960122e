"""Text-dataset audit operators on Spark DataFrames."""
