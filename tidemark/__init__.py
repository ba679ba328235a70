"""A versioned key-value table engine on Spark: upserts and deletes as a log, reads as DataFrames."""
