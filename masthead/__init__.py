"""Masthead: screening of proposed titles against large registries, on Spark."""
