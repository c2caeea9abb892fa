"""Graph builders, propagation, clustering and scores as DataFrame operators."""
