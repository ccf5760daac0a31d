"""Part of plantweave."""
