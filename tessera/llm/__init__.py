"""Training-data operators: dedup, licences, HTML, PII, mixing, language-model
scores, toxicity and decontamination. Nothing outside this subpackage (and
``corpus_pipeline.py``) imports it."""
