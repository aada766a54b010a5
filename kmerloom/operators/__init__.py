"""Relational and stateful operators over reads, k-mers and contigs."""
