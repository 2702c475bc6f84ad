"""Training-corpus operators: one module for each, queries in ``queries``."""
