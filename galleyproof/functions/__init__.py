"""Part of galleyproof."""
