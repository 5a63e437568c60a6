"""Whole runs: discovery, mapping, integration, and what they need around them."""
