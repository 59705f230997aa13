"""Readers, writers and validation of journals, prices, backtests and signals."""
