"""Operators for preparing training text: packing, deduplication, filters, sharding, chat formatting, privacy."""
