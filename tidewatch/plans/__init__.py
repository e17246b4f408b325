"""Ready-made flows: the analyses end to end, and their inputs from the tables."""
