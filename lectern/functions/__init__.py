"""Part of lectern; see README.md for the map of modules."""
