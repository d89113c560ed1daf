"""Whole programs (W1-W4) and plan helpers (checked broadcast)."""
