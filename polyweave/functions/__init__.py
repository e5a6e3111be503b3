"""Column-level geometry and index functions."""
