"""Readers and writers for the delimited, audio, image and model formats."""
