"""Training-data operators: packing, personal data, near-duplicates, scoring, extraction.

Nothing outside this subpackage imports it; ``polytrace.llm.queries`` binds
the operators to the tables of a corpus.
"""
