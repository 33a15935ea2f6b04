"""siftlake: dataset curation and evaluation analytics as Spark jobs."""
