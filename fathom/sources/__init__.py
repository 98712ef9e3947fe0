"""Readers that turn files into the relational model."""
