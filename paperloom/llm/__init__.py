"""Operators for text that is to train language models. Nothing outside imports them."""
