"""Operators on canonical datasets: frames in, lazy frames out."""
