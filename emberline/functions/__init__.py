"""Part of the emberline engine."""
