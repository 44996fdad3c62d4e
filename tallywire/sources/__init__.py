"""Frame scan, frame and text decoding, and the report sink."""
