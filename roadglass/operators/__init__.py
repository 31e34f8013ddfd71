"""Operators on DataFrames: events, profiles, risk."""
