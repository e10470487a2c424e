"""Whole queries and jobs, composed of sources and operators."""
