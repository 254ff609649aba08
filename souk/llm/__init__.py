"""Training-data operators (deduplication, filtering, tokenising, packing).

Self-contained: the rest of the library never imports this subpackage; the
registered queries live in ``souk.llm.queries``.
"""
