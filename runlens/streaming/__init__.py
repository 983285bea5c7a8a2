"""Structured Streaming jobs. Every sink write is keyed by the batch id, so a replayed batch changes nothing."""
