"""Operators over keyed series, journals, paths and allocations; each takes and returns lazy DataFrames."""
