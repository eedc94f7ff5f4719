"""The jobs a user runs, composed of the operators."""
