"""Column functions over sequences, motifs and statistics."""
