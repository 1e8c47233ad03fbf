"""Scans and sinks: FASTA, FASTQ, annotation tables, derived reads."""
