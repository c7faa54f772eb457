"""Training-data operators: tokens, quality, archives, pages, duplicates, languages, leaks and personal data."""
