"""Flow operators: coarsening, statistics, preparation, split, forest, metrics."""
