"""Training-data operators: PII, token output, toxicity, language-model scoring, mixing,
decontamination, quality rules, token counts, near-duplicates, HTML extraction, vector codes, hard
negatives and packing.

Nothing else in the library imports this subpackage.
"""
