"""Compilers from declarative definitions to DataFrame plans, and plan-level helpers."""
