"""Operators that prepare text for training language models; nothing else imports this package."""
