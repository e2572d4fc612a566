"""All registered queries of the subpackage and their SQL."""

from rxloom.llm import boosted, decontaminate, html_text, infill, langid, packing, quality, repair, sharding, simhash, substrings, url_filter, warc  # noqa: F401
from rxloom.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
