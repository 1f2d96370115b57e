"""Sources of history, files and manifests."""
