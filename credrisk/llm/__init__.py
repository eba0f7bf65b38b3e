"""Training-data operators: deduplication, decontamination, tokenizing, search, scoring.

Each module holds one operator with its own general interface; ``queries.py``
registers the thin ``opN_<name>`` queries and their SQL twins.  Nothing outside
this subpackage (and ``corpus_pipeline.py``) imports it.
"""
