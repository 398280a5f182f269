"""Relational engine for document extraction: geometry, suppression, parsing, review, export."""
