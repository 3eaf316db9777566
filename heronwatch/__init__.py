"""Batch and streaming jobs for early-warning systems, written as plain DataFrame functions."""
