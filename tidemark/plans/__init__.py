"""Composite jobs, and the views that stand in for market data on the bench tables."""
