"""Readers, writers and the adapters that bind provided tables to the data model."""
