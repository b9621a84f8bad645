"""Whole plans: single-pass refinement, the frozen index, the multi-tick loop, and the catalogue of queries."""
