"""The rollups that make sense on a live stream of samples."""
