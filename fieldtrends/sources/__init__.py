"""Readers, writers and dimension builders."""
