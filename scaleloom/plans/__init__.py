"""Lattice arithmetic and sampling plans, the typed operator graph and the fluent chain (driver side)."""
