"""Training-data operators: quality, packing, secrets, PII, rules, chat, BPE, near duplicates, language ID."""
