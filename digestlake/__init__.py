"""A content-addressed object repository and training-data operators on Spark."""
