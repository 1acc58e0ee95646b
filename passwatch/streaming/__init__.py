"""The same rules over streams of briefs."""
