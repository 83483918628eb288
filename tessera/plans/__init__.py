"""From query text to level plans."""
