"""Whole recoveries, and the encoding of tables as images."""
