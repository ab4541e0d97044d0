"""Readers: derived spatial tables, block arrays, SWC, tar, CSV points, JSON specs."""
