"""Registered queries: how the driver's tables are put through the operators."""
