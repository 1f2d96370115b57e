"""Reports and the command line."""
