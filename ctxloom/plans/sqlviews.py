"""DuckDB restatements of the fixture views (``ctxloom.sources.views``).

These are plain SQL text pieces used to build the oracle queries; they only
read the driver's pre-registered tables.
"""

from ctxloom.sources.views import DOC_SUFFIXES, EPOCH_2024

_SUFFIX_LIST = "[" + ", ".join("'" + s + "'" for s in DOC_SUFFIXES) + "]"
N_SUFFIX = len(DOC_SUFFIXES)

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"

DOCS = f"""docs AS (
  SELECT source AS project_id,
         lang || '/' || CAST(doc_id // 100 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR)
           || {_SUFFIX_LIST}[doc_id % {N_SUFFIX} + 1] AS rel_path,
         CAST(strlen(text) AS BIGINT) AS length,
         doc_id % 101 = 100 AS is_symlink,
         text, doc_id
  FROM documents)"""

WEB = f"""web_raw AS (
  SELECT regexp_extract(url, '{SCHEME}([^/?#]*)', 1) AS project_id,
         array_to_string(list_filter(string_split(replace(regexp_extract(url, '{SCHEME}[^/?#]*([^?#]*)', 1), '\\', '/'), '/'), lambda s: s <> ''), '/') AS rel_path,
         page_id, html
  FROM pages),
web AS (
  SELECT project_id, rel_path, max(page_id) AS page_id, arg_max(html, page_id) AS text,
         CAST(strlen(arg_max(html, page_id)) AS BIGINT) AS length, false AS is_symlink
  FROM web_raw GROUP BY project_id, rel_path)"""

PROJECTS = """projects AS (
  SELECT source AS project_id, min(doc_id) AS k, arg_min(lang, doc_id) AS lang
  FROM documents GROUP BY source)"""


def numbered_text(name: str, offset: int) -> str:
    return f"""{name} AS (
  SELECT p.project_id, b.text FROM projects p
  JOIN benchmark b ON b.item_id = (p.k + {offset}) % (SELECT count(*) FROM benchmark))"""


def prefixes(col: str) -> str:
    segs = f"list_filter(string_split(replace({col}, '\\', '/'), '/'), lambda s: s <> '')"
    return (f"list_transform(generate_series(0, len({segs})), lambda i: "
            f"array_to_string({segs}[1:i], '/'))")


def dir_prefixes(col: str) -> str:
    segs = f"list_filter(string_split(replace({col}, '\\', '/'), '/'), lambda s: s <> '')"
    return (f"list_transform(generate_series(0, greatest(len({segs}) - 1, 0)), lambda i: "
            f"array_to_string({segs}[1:i], '/'))")


def segments(col: str) -> str:
    return f"list_filter(string_split(replace({col}, '\\', '/'), '/'), lambda s: s <> '')"


def cdata(x: str) -> str:
    return f"('<![CDATA[' || replace({x}, ']]>', ']]]]><![CDATA[>') || ']]>')"


def xml_attr(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&apos;')")


def file_tokens(x: str) -> str:
    return f"CAST(ceil(CAST({x} AS FLOAT) / 4) AS BIGINT)"


def text_tokens(x: str) -> str:
    return f"coalesce(CAST(ceil(CAST(length({x}) AS FLOAT) / 4) AS BIGINT), 0)"


EPOCH = EPOCH_2024
TRUNCATED = "chr(10) || '[... truncated ...]' || chr(10)"
