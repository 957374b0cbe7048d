"""Whole plans: extraction, and the registered queries."""
