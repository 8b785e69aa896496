"""Training-data operators: WARC archives, mixing, near-duplicates, scoring, packing, chat windows, exact search.

Nothing outside this subpackage imports it.
"""
