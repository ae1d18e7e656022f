"""Plans: from a model predicate to a pruned scan."""
