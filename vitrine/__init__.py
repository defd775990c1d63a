"""Retail catalog analytics and document retrieval as Spark DataFrame jobs."""
