"""Sound files, and the store of features, logs and checkpoints."""
