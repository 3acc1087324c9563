"""Column functions (``Column -> Column``); all run JVM-side."""

from ctxloom.functions.paths import (basename, depth, dir_prefixes, normalize_path, parent_path,
                                     path_prefixes, root_label, segments)
from ctxloom.functions.text import (cdata_wrap, escape_xml_attr, file_class, html_to_text,
                                    rust_lines, strip_comments, trim_end, trim_unicode)
from ctxloom.functions.tokens import (budget_pct, document_tokens, file_tokens, text_tokens,
                                      tree_estimate_chars)

__all__ = [
    "basename", "depth", "dir_prefixes", "normalize_path", "parent_path", "path_prefixes", "root_label",
    "segments", "cdata_wrap", "escape_xml_attr", "file_class", "html_to_text", "rust_lines",
    "strip_comments", "trim_end", "trim_unicode", "budget_pct", "document_tokens", "file_tokens",
    "text_tokens", "tree_estimate_chars",
]
