"""Part of kelindan; see README.md."""
