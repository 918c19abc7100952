"""Readers and writers of recordings, exports and documents."""
