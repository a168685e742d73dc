"""Compositions of operators: the descriptor pipeline and the registered queries."""
