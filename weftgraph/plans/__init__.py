"""Driver-side loops and the cutting of lineage."""
