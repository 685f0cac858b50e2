"""Names of all queries of the library, and the DuckDB SQL that gives the same rows."""

from .plans import export_queries, feature_queries, form_queries, meter_queries, review_queries, score_queries, sound_queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "export_queries", "feature_queries", "form_queries", "meter_queries", "review_queries", "score_queries", "sound_queries"]
