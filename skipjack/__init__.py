"""skipjack: block skipping for model predicates on Spark."""
