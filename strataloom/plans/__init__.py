"""The reference queries over a folder of tables, by name, and their SQL."""

from . import case_queries, code_queries, diff_queries, file_queries, log_queries, misc_queries, part_queries, scalar_queries, source_queries, stats_queries, text_queries, tool_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
