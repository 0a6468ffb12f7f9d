"""Learners, scorers and tuning."""
