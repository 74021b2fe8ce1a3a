"""Training-data operators: scoring, deduplication, packing, scans and token counts.

Nothing outside this subpackage imports it. Every operator reads a DataFrame
with an integer id column and a text column, ignores all other columns (so
clashing names are harmless), and treats a null text as the empty text.
"""
