"""All registered queries of the subpackage and their SQL twins."""

from castwise.llm import classlm, collocations, embeddings, language, matroska, mixing, negatives, packing, passages, quality, simhash, suffix, url_reputation  # noqa: F401
from castwise.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
