"""stacklore: document, retrieval and catalogue analytics as Spark jobs."""
