"""Composite jobs: cash forecast, dashboard, reports, scenarios."""
