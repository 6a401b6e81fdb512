"""Evidence analytics over large text corpora and event logs, as Spark DataFrame jobs."""
