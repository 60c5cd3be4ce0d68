"""Flows built from the operators, with the study's own constants."""
