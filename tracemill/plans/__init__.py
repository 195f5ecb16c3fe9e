"""Whole runs over trace files, and the registered queries."""
