"""The ratchet gate over a stream of measurements."""
