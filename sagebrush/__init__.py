"""sagebrush: hybrid search, embedding jobs and log analytics as Spark jobs."""

__version__ = "0.1.0"
