"""Whole plans: reports over finished discoveries."""
