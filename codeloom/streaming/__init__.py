"""Incremental forms of coding and codebook maintenance."""
