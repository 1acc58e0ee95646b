"""Readers and writers of briefs, tiles and labels."""
