"""DataFrame operators: ranks, blends, metrics, folds, selection, evaluation statistics, models."""
