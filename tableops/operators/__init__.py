"""Operator families: transform (T), filters (F), calc (C), order (O), aggregate (A),
lookup (J), quality (V), rules (R), charts (G), profile (H, P), textjobs (X),
metrics (U3)."""
