"""Operators for preparing training data: token codes, search, sharding,
near-duplicate detection, extraction, language and toxicity models, packing
and mixing.  Nothing else in the library imports this subpackage."""
