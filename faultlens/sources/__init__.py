"""Readers for raw telemetry and stored results, and the writers that feed them."""
