"""Compositions of operators and the registered queries."""
