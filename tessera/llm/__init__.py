"""Training-data operators: licence scans, scoring, de-duplication, packing and secret scans."""
