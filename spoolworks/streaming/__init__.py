"""State machines as keyed streams, with batch twins over the same folds."""
