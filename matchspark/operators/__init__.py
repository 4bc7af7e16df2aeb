"""DataFrame-to-DataFrame operators; every one takes column names as parameters."""
