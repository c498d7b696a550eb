"""Relational operators over blocks, nodes, items and what is decoded from them."""
