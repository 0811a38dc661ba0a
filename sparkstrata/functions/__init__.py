"""Part of sparkstrata."""
