"""Readers and writers of sequence and motif files."""
