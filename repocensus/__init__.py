"""A census of source repositories and text corpora as Spark jobs."""
