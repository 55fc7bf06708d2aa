"""Readers and writers of the file shapes that survey and registry offices exchange."""
