"""Spark jobs for embedding-based 1:1 identity checks, their audit trail and the fraud risk derived from it."""
