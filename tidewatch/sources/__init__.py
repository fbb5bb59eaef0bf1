"""Readers: labelled flow CSVs and event logs, batch and stream."""
