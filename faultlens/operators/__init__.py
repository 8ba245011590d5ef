"""DataFrame-to-DataFrame operators over all cases at once."""
