"""Streams. The operators this library stands beside are batch only; what is here goes beyond them."""
