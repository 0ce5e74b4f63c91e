"""Operators for building training corpora: fingerprints, deduplication,
decontamination, scoring, token counts, mixing and licence scans."""
