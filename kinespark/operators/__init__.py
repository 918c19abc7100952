"""DataFrame operators over samples, fixes and laps."""
