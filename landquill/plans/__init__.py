"""Shared inputs of the registered queries."""
