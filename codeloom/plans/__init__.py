"""Whole phases of a study composed from the operators, and the registered queries."""
