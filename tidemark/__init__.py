"""tidemark: analytics over tagged time-series measurements, written for Apache Spark."""
