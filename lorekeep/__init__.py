"""Knowledge analytics on Spark: an append-only journal, a time-valid graph, retrieval and transcripts."""
