"""Compositions of operators: the tool registry and the investigation."""
