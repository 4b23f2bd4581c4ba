"""tracemill: Spark jobs for curating, packaging and scoring tool-use dialogues."""
