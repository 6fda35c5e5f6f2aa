"""Corpus packing, batch planning and run auditing as Spark jobs."""
