"""Readers and writers for the files of the corpus."""
