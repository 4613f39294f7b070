"""Aggregations, width estimators and information measures as Column expressions."""
