"""Training-data operators: WARC, secrets, HTML text, near duplicates, personal data,
chat rendering, token counts, BPE, benchmark decontamination and quality rules.

Nothing else in the library imports this subpackage.
"""
