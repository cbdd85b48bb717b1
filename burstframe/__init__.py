"""burstframe: photo-burst analytics as Spark DataFrames."""
