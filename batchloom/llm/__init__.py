"""Training-data pipeline operators: filters, fingerprints, near-duplicates, encoders and mixers."""
