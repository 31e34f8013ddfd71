"""Readers and writers: workbooks, delimited text, the source registry, single files."""
