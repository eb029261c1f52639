"""Part of millrace; see the README for the map of modules."""
