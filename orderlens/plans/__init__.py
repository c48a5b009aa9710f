"""Composed jobs: dashboard tables, model training, batch scoring, query registry."""
