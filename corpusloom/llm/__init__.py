"""Training-data operators for large corpora: near-duplicates, quality, media, web and tokens.

Nothing outside this package imports it; the queries over the standard
tables are in :mod:`corpusloom.llm.queries`.
"""
