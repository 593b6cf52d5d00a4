"""lapframe: fleet-scale telemetry analytics on Spark DataFrames."""
