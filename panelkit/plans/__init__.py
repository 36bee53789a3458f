"""Logical plans: bindings to the driver's tables and the registry of checked queries."""
