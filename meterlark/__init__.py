"""Part of the meterlark package."""
