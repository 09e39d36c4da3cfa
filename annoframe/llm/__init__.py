"""Operators for large training corpora, each with its query; nothing else imports this package."""
