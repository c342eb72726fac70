"""Operators for training text: tokenizer encoding, packing, repair of wrong decoding. Nothing outside imports this package."""
