"""Engines and commands that combine the operators."""
