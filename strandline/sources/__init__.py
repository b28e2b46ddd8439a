"""Readers and writers of the analytics engine's file formats."""
