"""Helixframe: nucleotide-sequence columns and corpus processing on Spark."""
