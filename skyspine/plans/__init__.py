"""Query products composed from the operators."""
