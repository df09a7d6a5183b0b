"""Readers and writers for entity tables, labelled pairs and results."""
