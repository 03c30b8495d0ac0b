"""Plans: whole jobs composed of operators."""
