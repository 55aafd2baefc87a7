"""Whole plans: corpus preparation and the registered queries."""
