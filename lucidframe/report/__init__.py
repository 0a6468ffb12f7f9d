"""Narratives, HTML reports and plot data."""
