"""Relational operators: extraction, fragment resolution, discovery, source maps."""
