"""Part of stemma; see README.md."""
