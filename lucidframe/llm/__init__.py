"""Operators for preparing text corpora: one module for each operator, `queries` registers them."""
