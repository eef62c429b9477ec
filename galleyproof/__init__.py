"""galleyproof: text, source-file and change-history analysis on Spark."""
