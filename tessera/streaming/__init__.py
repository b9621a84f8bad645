"""Structured Streaming forms of the keyed operators; an extension beside the batch folds."""
