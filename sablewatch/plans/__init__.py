"""Operators joined into whole data flows."""
