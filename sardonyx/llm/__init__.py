"""Operators of a large training-data pipeline (cleaning, dedup, scoring, mixing, output)."""
