"""Helioscope."""
