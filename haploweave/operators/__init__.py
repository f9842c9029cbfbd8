"""Relational steps from an alignment to haplotypes, distances and traits, and steps on graphs."""
