"""Column helpers used inside the operators."""
