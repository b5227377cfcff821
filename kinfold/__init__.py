"""Kinfold: identity matching over descriptor bags, written for Spark."""
