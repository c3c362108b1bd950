"""Training-data jobs on collected articles: filters, scores, near-duplicates, packing.

An *article* is the record the news and research collectors save: ``url`` identifies it and
``content`` is its text (any type of key and any column names can be given). Nothing else in the
library imports this subpackage.
"""
