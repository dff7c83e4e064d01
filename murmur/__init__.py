"""murmur: analytics over time-stamped speech and event sequences, written as Spark DataFrame jobs."""
