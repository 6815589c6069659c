"""Training-data operators: PII, URL filters, licences, packing, deduplication,
decontamination, quality, token output.  Nothing else in the library imports this."""
