"""Scoring of streams against a static gallery."""
