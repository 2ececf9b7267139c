"""Native column expressions: letters, cell ids, selections, tags, text rules."""

from gridframe.functions.letters import column_letters, column_index, parse_cell_id, cell_id
from gridframe.functions.selection import (
    parse_selection, resolve_rects, selection_in_bounds, format_selection, RECT_TYPE,
)
from gridframe.functions.tags import extract_tags, rewrite_tags
from gridframe.functions.text import value_shape, iso_to_date_text, code_block, blank

__all__ = [
    "column_letters", "column_index", "parse_cell_id", "cell_id",
    "parse_selection", "resolve_rects", "selection_in_bounds", "format_selection", "RECT_TYPE",
    "extract_tags", "rewrite_tags", "value_shape", "iso_to_date_text", "code_block", "blank",
]
