"""Training-data operators: packing, licences, personal data, duplicates, extraction, filters."""
