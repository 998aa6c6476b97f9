"""Registered queries, one module per area; importing the package fills the registry."""
