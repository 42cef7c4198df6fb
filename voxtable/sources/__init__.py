"""Readers, catalogs and writers."""
