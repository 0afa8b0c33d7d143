"""Readers and writers: JSON lines with exact line numbers, vectors, codes, metrics, codebooks."""
