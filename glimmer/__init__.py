"""Glimmer: media-search analytics and corpus preparation as Spark DataFrame jobs."""
