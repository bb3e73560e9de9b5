"""The corpus pipeline over the documents table: language ID, quality classifier, near-dedup, mixing, SentencePiece.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). ``run`` applies them, each result written as
Parquet and read back for the next. What each stage does, and with odd rows, is said at its function.
"""

from pipeweave.llm.stages import ORACLE_SQL, STAGES, encode, language_id, mix_sources, near_dedup, quality_classifier, run

__all__ = ["ORACLE_SQL", "STAGES", "encode", "language_id", "mix_sources", "near_dedup", "quality_classifier", "run"]
