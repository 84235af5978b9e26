"""Whole plans: the summary, its publication and its views."""
