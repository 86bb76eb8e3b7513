"""Readers, writers and the view of the driver's tables as a survey."""
