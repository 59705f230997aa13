"""Compositions: the book façade and the registered queries."""
