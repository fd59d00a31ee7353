"""Training-data operators: packing, licences, counts, scoring, language, copies, privacy, sketches, leaks, lines."""
