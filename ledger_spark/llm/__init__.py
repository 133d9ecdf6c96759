"""Training-data operators (toxicity, quality, language models, extraction,
de-duplication, mixing, language id, search, decontamination).

Nothing else in the library imports this subpackage; ``catalog`` holds the
registered queries and ``corpus_pipeline.py`` at the repository top chains five
of the operators into a pipeline.
"""
