"""Registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
DuckDB SQL that computes the same rows (``ORACLE_SQL[name]``).

Every query reads whole driver tables (or views Spark derives from them).
Column names and types match between the two sides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.constants import (FILE_CLASSES, HEAD_LINES, MAX_FILES, MAX_HISTORY, NAMES, OTHER_CLASS, TAIL_LINES, WORDS)
from ctxloom.functions.paths import basename, parent_path, segments
from ctxloom.functions.tokens import file_tokens
from ctxloom.functions.text import (HTML_BLOCK_TAGS, HTML_C1, HTML_NAMES, HTML_REFERENCE, cdata_wrap, decode_references, file_class, html_to_text,
                                    strip_comments)
from ctxloom.operators import assemble, config, content, estimate, history, lines, scan, select, tree, updates
from ctxloom.operators.lines import head_tail_text
from ctxloom.plans import common as C
from ctxloom.plans import sqlviews as V
from ctxloom.sources import document_store, views
from ctxloom.session import materialize, scratch_path
from ctxloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- SQL pieces
# Hand-written RE2 forms of the test rule sets (full match on a path prefix).
DOC_RX_SQL = (r"(?:.*\.tmp|.*\.lock|(.*/)?en/1(/.*)?|(.*/)?fr/2|(.*/)?de/.*\.o|.*\.[jp].*g"
              r"|(.*/)?es/(3|4)(/.*)?|(.*/)?/x|(.*/)?(a|b)(/.*)?)")
WEB_RX_SQL = r"(?:.*\.html|(.*/)?fr(/.*)?|(.*/)?de(/.*)?|(.*/)?es/7.*)"
DEFAULT_RX_SQL = r"(?:(.*/)?target/.*|(.*/)?\.git/.*|(.*/)?node_modules/.*|.*\.tmp)"


def _marked_sql(src: str, rx: str) -> str:
    """CTE ``marked`` over CTE ``src`` with ``hit`` and ``dir_hit``."""
    return f"""pre AS (SELECT *, {V.prefixes('rel_path')} AS prefixes FROM {src}),
marked AS (
  SELECT *, CASE WHEN hit IS NOT NULL AND hit <> prefixes[len(prefixes)] THEN hit END AS dir_hit
  FROM (SELECT *, list_filter(prefixes, lambda p: regexp_full_match(p, '{rx}'))[1] AS hit FROM pre))"""


def _stats_sql(limit: int) -> str:
    kept = "count(*) FILTER (WHERE NOT is_symlink AND hit IS NULL)"
    return f"""SELECT project_id,
  CAST(count(*) FILTER (WHERE NOT is_symlink AND dir_hit IS NULL) AS BIGINT) AS scanned,
  CAST(count(*) FILTER (WHERE NOT is_symlink AND hit IS NOT NULL) AS BIGINT) AS ignored,
  CAST(count(DISTINCT dir_hit) AS BIGINT) AS ignored_dirs,
  CAST(count(*) FILTER (WHERE is_symlink AND dir_hit IS NULL) AS BIGINT) AS symlinks,
  CAST(least({kept}, {limit}) AS BIGINT) AS loaded,
  least({kept}, {limit}) >= {limit} AS at_limit
FROM marked GROUP BY project_id"""


def _loaded_sql(limit: int = MAX_FILES) -> str:
    """CTE ``loaded`` (docs after rules and the limit); needs ``marked``."""
    return f"""kept AS (SELECT * FROM marked WHERE hit IS NULL AND NOT is_symlink),
loaded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rel_path) AS rn FROM kept)
           WHERE rn <= {limit})"""


DOCS_LOADED = f"""{V.DOCS},
{_marked_sql('docs', DOC_RX_SQL)},
{_loaded_sql()}"""

SELECTION_SQL = """selection AS (SELECT d.project_id, d.rel_path, l.quality = 1 AS selected FROM docs d JOIN labels l USING (doc_id)),
carried AS (SELECT f.*, coalesce(s.selected, false) AS sel0 FROM loaded f LEFT JOIN selection s USING (project_id, rel_path))"""

ACTIONS_SQL = f"""actions AS (
  SELECT d.project_id, regexp_extract(d.rel_path, '^(.*)/[^/]*$', 1) AS folder, l.quality = 1 AS value, d.doc_id AS seq
  FROM docs d JOIN labels l USING (doc_id)
  UNION ALL
  SELECT d.project_id, d.rel_path AS folder, false AS value, 1000000000 + d.doc_id AS seq
  FROM docs d JOIN labels l USING (doc_id) WHERE l.toxic = 1),
latest_action AS (SELECT project_id, folder, arg_max(value, seq) AS value FROM actions GROUP BY project_id, folder),
tick_hits AS (
  SELECT f.project_id, f.rel_path, arg_max(a.value, a.seq) AS value
  FROM (SELECT project_id, rel_path, unnest({V.prefixes('rel_path')}) AS folder FROM carried) f
  JOIN (SELECT l.*, (SELECT max(seq) FROM actions x WHERE x.project_id = l.project_id AND x.folder = l.folder) AS seq
        FROM latest_action l) a USING (project_id, folder)
  GROUP BY f.project_id, f.rel_path),
ticked AS (SELECT c.*, coalesce(t.value, c.sel0) AS selected FROM carried c LEFT JOIN tick_hits t USING (project_id, rel_path))"""


def _class_case(name: str) -> str:
    whens = []
    for label, sufs in FILE_CLASSES:
        cond = " OR ".join(f"ends_with({name}, '{s}')" for s in sufs)
        whens.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(whens) + f" ELSE '{OTHER_CLASS}' END"


def _references_sql(x: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in HTML_NAMES.items()) + "}"
    name = f"regexp_extract(p, '{HTML_REFERENCE}', 1)"
    rest = f"substr(p, length({name}) + 2)"
    n = f"(CASE WHEN lower({name}[1:2]) = '#x' THEN CAST('0x' || {name}[3:] AS BIGINT) ELSE CAST({name}[2:] AS BIGINT) END)"
    code = (f"(CASE WHEN {n} = 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN 65533 WHEN {n} = 160 THEN 32 "
            f"WHEN {n} BETWEEN 128 AND 159 THEN [{', '.join(map(str, HTML_C1))}][{n} - 127] ELSE {n} END)")
    part = (f"CASE WHEN i = 1 THEN p WHEN {name}[1:1] = '#' THEN chr(CAST({code} AS INTEGER)) || {rest} "
            f"ELSE coalesce({names}[{name}] || {rest}, '&' || p) END")
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: {part}), '')"


def _html_text_sql(x: str, width: int = 80) -> str:
    tag_rest = r"(?:[\t\n\x0B\f\r /][^>]*)?>"
    out = x
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    raw = [rf"<{t}{tag_rest}.*?</{t}[\t\n\x0B\f\r ]*>" for t in ("script", "style", "head")]
    out = f"regexp_replace({out}, '(?is){raw[0]}|{raw[1]}', '', 'g')"
    out = f"regexp_replace({out}, '(?is){raw[2]}', '', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{'|'.join(HTML_BLOCK_TAGS)}){tag_rest}', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    out = _references_sql(out)
    out = rf"regexp_replace({out}, '[\t\x0B\f\r ]{{2,}}|[\t\x0B\f\r]', ' ', 'g')"
    out = rf"regexp_replace({out}, ' +\n *|\n +', chr(10), 'g')"
    out = rf"regexp_replace({out}, '\n{{2,}}', chr(10), 'g')"
    out = f"trim({out}, ' ' || chr(10))"
    out = rf"regexp_replace({out}, '([^\n]{{1,{width}}})(?: +|\n|\z)', '\1' || chr(10), 'g')"
    return rf"regexp_replace({out}, '\n\z', '')"


def _strip_sql(x: str) -> str:
    t = r"""(?:[^"'\\/#]|\\["'\\]?|"(?:[^"\\]|\\.)*(?:"|\\?$)|'(?:[^'\\]|\\.)*(?:'|\\?$))"""
    rx = r"^((?:/?" + t + r")*)(?://.*|(/?)(?:#.*)?)$"
    rx = rx.replace("'", "''")
    ws = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
    line = rf"rtrim(regexp_replace(l, '{rx}', '\1\2'), {ws})"
    return (f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {line}), "
            f"lambda l: l <> ''), chr(10))")


def _rust_lines_sql(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '\\r?\\n')"
    return (f"CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN ends_with({x}, chr(10)) "
            f"THEN {parts}[1:len({parts}) - 1] ELSE {parts} END")


def _head_tail_sql(x: str, n: int, m: int) -> str:
    ls = _rust_lines_sql(x)
    cut = (f"list_concat({ls}[1:{n}], ['[... output truncated ...]'], "
           f"{ls}[len({ls}) - {m} + 1:len({ls})])") if m > 0 else f"list_concat({ls}[1:{n}], ['[... output truncated ...]'])"
    kept = f"CASE WHEN len({ls}) <= {n + m} THEN {ls} ELSE {cut} END"
    return f"array_to_string(list_transform({kept}, lambda l: l || chr(10)), '')"


def _tree_sql(files: str, root: str = "project_id") -> str:
    """CTEs ``nodes``, ``ordered``, ``tlines`` and ``trees`` over CTE ``files``."""
    segs = V.segments("rel_path")
    return f"""tsegs AS (SELECT project_id, {segs} AS segs FROM {files}),
nodes AS (
  SELECT DISTINCT project_id, array_to_string(segs[1:d], '/') AS path, array_to_string(segs[1:d - 1], '/') AS parent,
         segs[d] AS name, d AS depth, d = len(segs) AS is_file
  FROM (SELECT project_id, segs, unnest(generate_series(1, len(segs))) AS d FROM tsegs WHERE len(segs) > 0)),
ordered AS (SELECT *, (lead(1) OVER (PARTITION BY project_id, parent ORDER BY is_file, name)) IS NULL AS is_last FROM nodes),
anc AS (
  SELECT project_id, path, is_file, a_depth, array_to_string(string_split(path, '/')[1:a_depth], '/') AS a_path
  FROM (SELECT project_id, path, is_file, unnest(generate_series(1, depth - 1)) AS a_depth FROM ordered WHERE depth > 1)),
anc2 AS (
  SELECT a.project_id, a.path, a.is_file,
         string_agg(CASE WHEN o.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.a_depth) AS prefix,
         list(o.name ORDER BY a.a_depth) AS anames
  FROM anc a JOIN ordered o ON o.project_id = a.project_id AND o.path = a.a_path AND o.depth = a.a_depth AND NOT o.is_file
  GROUP BY a.project_id, a.path, a.is_file),
tlines AS (
  SELECT n.project_id, coalesce(a.prefix, '') || CASE WHEN n.is_last THEN '└─ ' ELSE '├─ ' END || n.name AS line,
         list_concat(list_transform(coalesce(a.anames, []::VARCHAR[]), lambda x: {{'f': false, 'n': x}}),
                     [{{'f': n.is_file, 'n': n.name}}]) AS sort_key
  FROM ordered n LEFT JOIN anc2 a ON a.project_id = n.project_id AND a.path = n.path AND a.is_file = n.is_file),
tproj AS (SELECT DISTINCT project_id FROM {files}),
trees AS (
  SELECT p.project_id, {root} || '/' || chr(10) || coalesce(string_agg(t.line || chr(10), '' ORDER BY t.sort_key), '') AS tree
  FROM tproj p LEFT JOIN tlines t USING (project_id) GROUP BY p.project_id)"""


# ------------------------------------------------------------ step 1: slice
@register("folder_tokens", f"""WITH {V.DOCS}
SELECT project_id, folder, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(tok) AS BIGINT) AS tokens
FROM (SELECT project_id, unnest({V.dir_prefixes('rel_path')}) AS folder, {V.file_tokens('length')} AS tok FROM docs)
GROUP BY project_id, folder""")
def q_folder_tokens(spark, sf_dir):
    """Tokens of every file below each folder."""
    r = tree.folder_rollup(views.docs_meta(spark, sf_dir))
    return r.select("project_id", "folder", F.col("total").alias("n_files"), "tokens")


@register("class_tokens", f"""WITH {V.DOCS}
SELECT project_id, file_class, CAST(count(*) AS BIGINT) AS n_files, CAST(sum({V.file_tokens('length')}) AS BIGINT) AS tokens
FROM (SELECT *, {_class_case("regexp_extract(rel_path, '[^/]*$')")} AS file_class FROM docs)
GROUP BY project_id, file_class""")
def q_class_tokens(spark, sf_dir):
    """Files and tokens per file class."""
    d = views.docs_meta(spark, sf_dir).withColumn("file_class", file_class(basename(F.col("rel_path"))))
    return d.groupBy("project_id", "file_class").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(file_tokens(F.col("length"))).cast("bigint").alias("tokens"))


@register("path_parts", f"""WITH {V.WEB.split('web AS')[0].rstrip().rstrip(',')}
SELECT page_id, project_id, rel_path, regexp_extract(rel_path, '[^/]*$') AS name,
  array_to_string({V.segments('rel_path')}[1:greatest(len({V.segments('rel_path')}) - 1, 0)], '/') AS parent,
  CAST(len({V.segments('rel_path')}) AS INTEGER) AS depth
FROM web_raw""")
def q_path_parts(spark, sf_dir):
    """Basename, parent and depth of every page path."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", views.URL_SCHEME + r"([^/?#]*)", 1)
    path = F.regexp_extract("url", views.URL_SCHEME + r"[^/?#]*([^?#]*)", 1)
    rel = F.array_join(segments(path), "/")
    w = p.select("page_id", host.alias("project_id"), rel.alias("rel_path"))
    return w.select("page_id", "project_id", "rel_path", basename(F.col("rel_path")).alias("name"),
                    parent_path(F.col("rel_path")).alias("parent"),
                    F.size(segments(F.col("rel_path"))).alias("depth"))


# ------------------------------------------------------ step 2: scan, limit
@register("scan_stats", f"""WITH {V.DOCS},
{_marked_sql('docs', DOC_RX_SQL)}
{_stats_sql(MAX_FILES)}""")
def q_scan_stats(spark, sf_dir):
    """Scanned / ignored / ignored dirs / symlinks / loaded per project."""
    marked = scan.mark_hits(views.docs_meta(spark, sf_dir), C.doc_rules_regex())
    return scan.scan_stats(marked)


@register("web_scan_stats", f"""WITH {V.WEB},
{_marked_sql('web', WEB_RX_SQL)}
{_stats_sql(MAX_FILES)}""")
def q_web_scan_stats(spark, sf_dir):
    marked = scan.mark_hits(views.web(spark, sf_dir).drop("content"), C.web_rules_regex())
    return scan.scan_stats(marked)


@register("loaded_files", f"""WITH {DOCS_LOADED}
SELECT project_id, rel_path, length, {V.file_tokens('length')} AS tokens FROM loaded""")
def q_loaded_files(spark, sf_dir):
    """Files a project loads, with their size estimate."""
    f = C.docs_loaded(spark, sf_dir)
    return f.select("project_id", "rel_path", "length", file_tokens(F.col("length")).alias("tokens"))


@register("file_limit", f"""WITH {V.DOCS},
{_marked_sql('docs', DOC_RX_SQL)},
{_loaded_sql(C.SMALL_LIMIT)}
SELECT project_id, rel_path FROM loaded""")
def q_file_limit(spark, sf_dir):
    """First files by path per project under a small limit (L1)."""
    return C.docs_loaded(spark, sf_dir, C.SMALL_LIMIT).select("project_id", "rel_path")


@register("file_limit_stats", f"""WITH {V.DOCS},
{_marked_sql('docs', DOC_RX_SQL)}
{_stats_sql(C.SMALL_LIMIT)}""")
def q_file_limit_stats(spark, sf_dir):
    marked = scan.mark_hits(views.docs_meta(spark, sf_dir), C.doc_rules_regex())
    return scan.scan_stats(marked, C.SMALL_LIMIT)


# -------------------------------------------------------- step 3: selection
@register("selection_carry_over", f"""WITH {DOCS_LOADED},
{SELECTION_SQL}
SELECT project_id, rel_path, sel0 AS selected FROM carried""")
def q_selection_carry_over(spark, sf_dir):
    """Earlier ticks kept by path, new files unticked."""
    out = select.carry_over(C.docs_loaded(spark, sf_dir), views.selection(spark, sf_dir))
    return out.select("project_id", "rel_path", "selected")


@register("folder_select", f"""WITH {DOCS_LOADED},
{SELECTION_SQL},
{ACTIONS_SQL}
SELECT project_id, rel_path, selected FROM ticked""")
def q_folder_select(spark, sf_dir):
    """Folder and file ticks applied, latest action wins."""
    return C.docs_selected_state(spark, sf_dir).select("project_id", "rel_path", "selected")


@register("selected_files", f"""WITH {DOCS_LOADED},
{SELECTION_SQL},
{ACTIONS_SQL}
SELECT project_id, rel_path, length FROM ticked WHERE selected""")
def q_selected_files(spark, sf_dir):
    """Ticked files only, in path order per project."""
    return select.selected_only(C.docs_selected_state(spark, sf_dir)).select("project_id", "rel_path", "length")


@register("folder_tristate", f"""WITH {DOCS_LOADED},
{SELECTION_SQL},
{ACTIONS_SQL}
SELECT project_id, folder, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS selected,
  CAST(sum({V.file_tokens('length')}) AS BIGINT) AS tokens,
  CASE WHEN count(*) FILTER (WHERE selected) = count(*) THEN 'all'
       WHEN count(*) FILTER (WHERE selected) > 0 THEN 'some' ELSE 'none' END AS state
FROM (SELECT *, unnest({V.dir_prefixes('rel_path')}) AS folder FROM ticked)
GROUP BY project_id, folder""")
def q_folder_tristate(spark, sf_dir):
    """Per folder: files, ticked files, tokens and the tri-state (A2, A3)."""
    r = tree.folder_rollup(C.docs_ticked(spark, sf_dir))
    return r.select("project_id", "folder", "total", "selected", "tokens", "state")


# -------------------------------------------------------------- step 4: tree
@register("tree_nodes", f"""WITH {V.WEB},
{_marked_sql('web', WEB_RX_SQL)},
{_loaded_sql()},
{_tree_sql('loaded')}
SELECT project_id, path, is_file, CAST(depth AS INTEGER) AS depth, name, is_last FROM ordered""")
def q_tree_nodes(spark, sf_dir):
    """Distinct folder and file nodes with sibling order (A5, L3)."""
    n = tree.with_sibling_order(tree.tree_nodes(C.web_loaded(spark, sf_dir)))
    return n.select("project_id", "path", "is_file", "depth", "name", "is_last")


@register("tree_render", f"""WITH {DOCS_LOADED},
{_tree_sql('loaded')}
SELECT project_id, tree FROM trees""")
def q_tree_render(spark, sf_dir):
    """ASCII tree of every loaded file per project."""
    return tree.render_tree(C.docs_loaded(spark, sf_dir))


@register("web_tree_render", f"""WITH {V.WEB},
{_marked_sql('web', WEB_RX_SQL)},
{_loaded_sql()},
{_tree_sql('loaded')}
SELECT project_id, tree FROM trees""")
def q_web_tree_render(spark, sf_dir):
    return tree.render_tree(C.web_loaded(spark, sf_dir))


# ------------------------------------------------------ step 5: the document
@register("capped_content", f"""WITH {V.DOCS},
h AS (SELECT project_id, rel_path, text, CAST(strlen(text) AS BIGINT) AS n, hex(encode(text)) AS hx FROM docs),
k AS (SELECT *, CASE WHEN text IS NULL THEN 'missing'
                     WHEN regexp_matches(substr(hx, 1, 2048), '^(?:..)*?00') THEN 'binary'
                     WHEN n <= {C.SMALL_CAP} THEN 'whole' ELSE 'truncated' END AS kind FROM h)
SELECT project_id, rel_path, kind, n AS n_bytes,
  CASE WHEN kind = 'truncated' THEN substr(hx, 1, 2 * greatest({C.SMALL_CAP // 2}, least(1024, n))) ELSE hx END AS head_hex,
  CASE WHEN kind = 'truncated' THEN right(hx, {2 * (C.SMALL_CAP // 2)}) END AS tail_hex
FROM k""")
def q_capped_content(spark, sf_dir):
    """Byte cap at a small limit: kind, head and tail bytes."""
    return content.capped_parts(views.docs(spark, sf_dir), C.SMALL_CAP)


CONFIG_SQL = f"""{V.PROJECTS},
{V.numbered_text('t1', 1)},
{V.numbered_text('t2', 2)},
{V.numbered_text('t3', 3)},
layers AS (
  SELECT p.project_id, 0 AS layer, '/ws/' || p.project_id || '/{NAMES.system_file}' AS path,
         CASE WHEN p.k % 3 = 0 THEN t1.text END AS text FROM projects p LEFT JOIN t1 USING (project_id)
  UNION ALL
  SELECT p.project_id, 1, '{views.ENV_SYSTEM_FILE}', CASE WHEN p.k % 3 = 1 THEN t2.text END
  FROM projects p LEFT JOIN t2 USING (project_id)
  UNION ALL
  SELECT project_id, 2, '{views.DEFAULT_SYSTEM_FILE}', NULL FROM projects),
sys0 AS (
  SELECT project_id, min(layer) FILTER (WHERE text IS NOT NULL) AS layer,
         arg_min(text, layer) FILTER (WHERE text IS NOT NULL) AS found,
         string_agg(path, ', ' ORDER BY layer) AS tried
  FROM layers GROUP BY project_id),
addons AS (SELECT p.project_id, t3.text FROM projects p JOIN t3 USING (project_id) WHERE p.k % 2 = 0),
sys AS (
  SELECT s.project_id, s.layer,
    CASE WHEN s.layer IS NOT NULL THEN s.found
         ELSE '{WORDS.system_failed}"'
              || replace(replace(replace(replace(replace('{WORDS.system_missing}' || s.tried, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')
              || '"' END
    || CASE WHEN a.text IS NOT NULL THEN chr(10) || chr(10) || a.text ELSE '' END AS system
  FROM sys0 s LEFT JOIN addons a USING (project_id))"""


@register("system_prompts", f"""WITH {CONFIG_SQL}
SELECT project_id, system, layer FROM sys""")
def q_system_prompts(spark, sf_dir):
    """Layered system text with error text, plus the addon."""
    s = config.with_addon(config.system_text(views.config_layers(spark, sf_dir)), views.addons(spark, sf_dir))
    return s.select("project_id", "system", "layer")


@register("lossy_cap", f"""WITH {V.DOCS},
h AS (SELECT project_id, rel_path, CAST(strlen(text) AS BIGINT) AS n, hex(encode(text)) AS hx FROM docs),
c AS (SELECT *, substr(hx, 1, 2 * greatest({C.SMALL_CAP // 2}, least(1024, n))) AS head, right(hx, {C.SMALL_CAP // 2 * 2}) AS tail FROM h)
SELECT project_id, rel_path, CASE WHEN n <= {C.SMALL_CAP} THEN decode(unhex(hx)) ELSE
  decode(unhex(regexp_replace(head, '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].)?(?:[89AB].)?)$', '\\1EFBFBD')))
  || {V.TRUNCATED}
  || decode(unhex(repeat('EFBFBD', CAST(len(regexp_extract(tail, '^(?:[89AB].)*')) // 2 AS INTEGER)) || regexp_replace(tail, '^(?:[89AB].)*', ''))) END AS text
FROM c""")
def q_lossy_cap(spark, sf_dir):
    """Text under a small cap: characters broken at the two cuts decode lossily."""
    return views.docs(spark, sf_dir).select("project_id", "rel_path", content.capped_text("content", C.SMALL_CAP).alias("text"))


EDGE_TEXT_SQL = """CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN repeat('A', 1023) || chr(0) || text WHEN 2 THEN repeat('A', 1024) || chr(0) || text
  WHEN 3 THEN text || ']]>' || text ELSE text END"""


@register("content_edges", f"""WITH e AS (SELECT doc_id, {EDGE_TEXT_SQL} AS t FROM documents),
k AS (SELECT doc_id, t, CASE WHEN t IS NULL THEN 'missing' WHEN doc_id % 5 = 1 THEN 'binary' ELSE 'whole' END AS kind FROM e)
SELECT doc_id, kind, {V.cdata("CASE kind WHEN 'missing' THEN '[error reading file]' || chr(10) WHEN 'binary' THEN '[binary file omitted]' || chr(10) ELSE t END")} AS wrapped
FROM k""")
def q_content_edges(spark, sf_dir):
    """Missing content, a NUL on either side of the sniff window and ``]]>`` in the text."""
    d = table(spark, sf_dir, "documents")
    a = lambda n: F.concat(F.repeat(F.lit("A"), F.lit(n)), F.lit("\0"), F.col("text"))
    k = F.col("doc_id") % 5
    t = F.when(k == 1, a(1023)).when(k == 2, a(1024)).when(k == 3, F.concat("text", F.lit("]]>"), "text")).when(k == 4, F.col("text"))
    c = t.cast("binary")
    return d.select("doc_id", content.content_kind(c).alias("kind"), cdata_wrap(content.capped_text(c)).alias("wrapped"))


@register("path_edges", f"""WITH p AS (SELECT doc_id, lang || '\\' || CAST(doc_id // 100 AS VARCHAR) || '//' || source || '\\' || CAST(doc_id AS VARCHAR) || '.md' AS rel_path FROM documents)
SELECT doc_id, regexp_extract(rel_path, '[^/]*$') AS name,
  array_to_string({V.segments('rel_path')}[1:greatest(len({V.segments('rel_path')}) - 1, 0)], '/') AS parent,
  CAST(len({V.segments('rel_path')}) AS INTEGER) AS depth
FROM p""")
def q_path_edges(spark, sf_dir):
    """Paths with backslashes and empty segments."""
    rel = F.concat("lang", F.lit("\\"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("//"), "source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".md"))
    p = table(spark, sf_dir, "documents").select("doc_id", rel.alias("rel_path"))
    return p.select("doc_id", basename(F.col("rel_path")).alias("name"), parent_path(F.col("rel_path")).alias("parent"),
                    F.size(segments(F.col("rel_path"))).alias("depth"))


def _terminal(spark, sf_dir):
    """Per project: the latest command of user ``k`` and head/tail lines of
    document ``k`` as its output."""
    p = views.projects(spark, sf_dir)
    # the front of the MRU list is the latest use: one grouped max, no ranking
    last = history.clean_commands(views.history(spark, sf_dir)).groupBy("user_id").agg(
        F.max_by("command", F.struct("ts", "seq")).alias("command"))
    cmd = p.join(last, p["k"] == last["user_id"], "left").select("project_id", "command")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = p.join(docs, p["k"] == docs["doc_id"], "left").select(
        "project_id", head_tail_text(F.col("text")).alias("output"))
    return cmd.join(out, "project_id")


TERMINAL_SQL = f"""hist AS (SELECT user_id, event_type || ' ' || props AS command, ts, event_id AS seq FROM events WHERE event_type <> 'error'),
last_cmd AS (SELECT user_id, arg_max(command, (ts, seq)) AS command FROM hist GROUP BY user_id),
terminal AS (
  SELECT p.project_id, c.command, {_head_tail_sql('d.text', HEAD_LINES, TAIL_LINES)} AS output
  FROM projects p LEFT JOIN last_cmd c ON c.user_id = p.k LEFT JOIN documents d ON d.doc_id = p.k)"""


def _fragments(spark, sf_dir, cap: int | None = None, state=None):
    # the loaded files with their ticks feed the tree and the file list: write once
    state = materialize(C.docs_selected_state(spark, sf_dir), "docs-state") if state is None else state
    trees = tree.render_tree(state)
    chosen = select.selected_only(state).select("project_id", "rel_path", "doc_id")
    files = C.with_content(chosen, spark, sf_dir)
    system = config.with_addon(config.system_text(views.config_layers(spark, sf_dir)), views.addons(spark, sf_dir))
    kwargs = {} if cap is None else {"cap": cap}
    return assemble.fragments(views.projects(spark, sf_dir), system, views.instructions(spark, sf_dir), trees,
                              files, _terminal(spark, sf_dir), **kwargs)


FRAGMENTS_SQL = f"""{DOCS_LOADED},
{SELECTION_SQL},
{ACTIONS_SQL},
{_tree_sql('ticked')},
{CONFIG_SQL},
{V.numbered_text('instr', 0)},
{TERMINAL_SQL},
head AS (
  SELECT p.project_id, {V.cdata("coalesce(i.text, '')")} AS ci, s.system, tr.tree, t.command, t.output
  FROM projects p LEFT JOIN instr i USING (project_id) LEFT JOIN sys s USING (project_id)
  LEFT JOIN trees tr USING (project_id) LEFT JOIN terminal t USING (project_id)),
frags AS (
  SELECT project_id, 1 AS section, '' AS ord, '{WORDS.system_open}' || {V.cdata("coalesce(system, '')")} || '{WORDS.system_close}' AS text FROM head
  UNION ALL SELECT project_id, 2, '', '<instruction>' || ci || '</instruction>' || chr(10) FROM head
  UNION ALL SELECT project_id, 3, '', '<file_tree>' || chr(10) || {V.cdata("coalesce(tree, '')")} || chr(10) || '</file_tree>' || chr(10) FROM head
  UNION ALL SELECT project_id, 4, '', '<code>' || chr(10) FROM head
  UNION ALL SELECT project_id, 6, '', '</code>' || chr(10) || chr(10) FROM head
  UNION ALL SELECT project_id, 7, '', '<terminal_command>' || {V.cdata("coalesce(command, '')")} || '</terminal_command>' || chr(10) FROM head
  UNION ALL SELECT project_id, 8, '', '<terminal_output>' || {V.cdata("coalesce(output, '')")} || '</terminal_output>' || chr(10) FROM head
  UNION ALL SELECT project_id, 9, '', '<instruction>' || ci || '</instruction>' || chr(10) FROM head
  UNION ALL SELECT t.project_id, 5, t.rel_path,
    '<file path="' || {V.xml_attr('t.rel_path')} || '">' || {V.cdata('d.text')} || '</file>' || chr(10)
  FROM ticked t JOIN documents d USING (doc_id) WHERE t.selected)"""


@register("context_fragments", f"""WITH {FRAGMENTS_SQL}
SELECT project_id, section, ord, text FROM frags""")
def q_context_fragments(spark, sf_dir):
    """Ordered document pieces per project."""
    return _fragments(spark, sf_dir)


def _chunks_sql(chunk_bytes: int) -> str:
    return f"""WITH {FRAGMENTS_SQL},
limits AS (SELECT project_id, count(*) >= {MAX_FILES} AS at_limit FROM ticked GROUP BY project_id),
placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY project_id ORDER BY slot) - 1 AS chunk_no
  FROM (SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY project_id ORDER BY section, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  // {chunk_bytes} AS slot FROM frags)),
whole AS (SELECT project_id, sum(strlen(text)) AS n, count(*) AS f, max(chunk_no) + 1 AS c FROM placed GROUP BY project_id)
SELECT p.project_id, CAST(p.chunk_no AS INTEGER) AS chunk_no, CAST(any_value(w.c) AS INTEGER) AS n_chunks, CAST(any_value(w.n) AS BIGINT) AS n_bytes,
  CAST(any_value(w.n) // 3 AS BIGINT) AS n_tokens, CAST(any_value(w.f) AS BIGINT) AS n_fragments, any_value(l.at_limit) AS at_limit,
  string_agg(p.text, '' ORDER BY p.section, p.ord) AS text
FROM placed p JOIN whole w USING (project_id) LEFT JOIN limits l USING (project_id)
GROUP BY p.project_id, p.chunk_no"""


def _documents(spark, sf_dir, chunk_bytes):
    state = materialize(C.docs_selected_state(spark, sf_dir), "docs-state")
    # the fragment table is the primary output (S6); the documents are built from it
    frags = materialize(_fragments(spark, sf_dir, state=state), "fragments")
    limits = state.groupBy("project_id").agg((F.count(F.lit(1)) >= MAX_FILES).alias("at_limit"))
    return assemble.documents(frags, chunk_bytes, limits)


@register("context_document", _chunks_sql(assemble.CHUNK_BYTES))
def q_context_document(spark, sf_dir):
    """The flagship: one context document per project with its token count."""
    return _documents(spark, sf_dir, assemble.CHUNK_BYTES)


@register("context_chunks", _chunks_sql(C.SMALL_CHUNK))
def q_context_chunks(spark, sf_dir):
    """The same documents in chunks small enough to split most of them."""
    return _documents(spark, sf_dir, C.SMALL_CHUNK)


@register("fragment_sink", f"""WITH {FRAGMENTS_SQL}
SELECT project_id, section, ord, text FROM frags""")
def q_fragment_sink(spark, sf_dir):
    """The fragment table written by the sink and read back."""
    path = scratch_path(spark, "tables", f"fragment-sink-{uuid.uuid4().hex[:12]}")
    assemble.write_fragments(_fragments(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("incremental_sink", _chunks_sql(C.SMALL_CHUNK))
def q_incremental_sink(spark, sf_dir):
    """Documents kept on disk: a first version without the notes, then all files, of
    which only the chunks that changed are joined and written (S6, A6)."""
    store = scratch_path(spark, "tables", f"documents-{uuid.uuid4().hex[:12]}")
    state = materialize(C.docs_selected_state(spark, sf_dir), "docs-state")
    frags = materialize(_fragments(spark, sf_dir, state=state), "fragments")
    limits = state.groupBy("project_id").agg((F.count(F.lit(1)) >= MAX_FILES).alias("at_limit"))
    document_store.update(frags.where("NOT endswith(ord, '.md')"), store, C.SMALL_CHUNK, limits)
    document_store.update(frags, store, C.SMALL_CHUNK, limits)
    return document_store.documents(spark, store)


# ------------------------------------------------------------ step 6: sizes
REMOTES_SQL = f"""remotes AS (
  SELECT 'src' || CAST(page_id % 20 AS VARCHAR) AS project_id, url, {_html_text_sql('html')} AS content, page_id % 3 <> 0 AS include
  FROM pages)"""

ESTIMATE_SQL = f"""{DOCS_LOADED},
{SELECTION_SQL},
{ACTIONS_SQL},
{V.PROJECTS},
{V.numbered_text('instr', 0)},
{REMOTES_SQL},
fagg AS (SELECT project_id, CAST(sum(strlen(rel_path) + 4) AS BIGINT) AS tree_chars,
                CAST(sum(CASE WHEN selected THEN {V.file_tokens('length')} ELSE 0 END) AS BIGINT) AS file_tokens
         FROM ticked GROUP BY project_id),
ragg AS (SELECT project_id, CAST(sum({V.text_tokens('content')}) AS BIGINT) AS remote_tokens FROM remotes WHERE include GROUP BY project_id),
est AS (
  SELECT p.project_id, coalesce({V.text_tokens('i.text')}, 0) AS instruction_tokens,
         CAST(ceil(CAST(coalesce(f.tree_chars, 0) + 16 AS FLOAT) / 4) AS BIGINT) AS tree_tokens,
         coalesce(f.file_tokens, 0) AS file_tokens, coalesce(r.remote_tokens, 0) AS remote_tokens
  FROM projects p LEFT JOIN fagg f USING (project_id) LEFT JOIN instr i USING (project_id) LEFT JOIN ragg r USING (project_id)),
est2 AS (SELECT *, CAST(2 * instruction_tokens + tree_tokens + file_tokens + remote_tokens AS BIGINT) AS estimate FROM est)"""


def _estimate(spark, sf_dir):
    return estimate.estimate(views.instructed_projects(spark, sf_dir), C.docs_selected_state(spark, sf_dir), remotes=views.remotes(spark, sf_dir))


@register("estimate_tokens", f"""WITH {ESTIMATE_SQL}
SELECT project_id, instruction_tokens, tree_tokens, file_tokens, remote_tokens, estimate FROM est2""")
def q_estimate_tokens(spark, sf_dir):
    """Fast size estimate per project."""
    return _estimate(spark, sf_dir)


@register("budget_share", f"""WITH {ESTIMATE_SQL}
SELECT project_id, estimate, CAST(CAST(round(CAST(estimate AS DECIMAL(20,0)) * 100 / 200000, 2) AS DECIMAL(12,2)) AS DOUBLE) AS budget_pct,
  estimate > 200000 AS over_budget,
  'Token count (approx): ' || format('{{:,}}', estimate) || ' / 200,000 (' || CAST(CAST(round(CAST(estimate AS DECIMAL(20,0)) * 100 / 200000, 2) AS DECIMAL(12,2)) AS VARCHAR) || '%)' AS label
FROM est2""")
def q_budget_share(spark, sf_dir):
    """Budget share and label."""
    return estimate.budget(_estimate(spark, sf_dir))


# ---------------------------------------------------------- step 7: cleaning
@register("strip_comments", f"""SELECT doc_id, {_strip_sql('text')} AS stripped FROM documents""")
def q_strip_comments(spark, sf_dir):
    """Comment stripping of every document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", strip_comments(F.col("text")).alias("stripped"))


@register("strip_comments_web", f"""SELECT page_id, {_strip_sql("url || chr(10) || html")} AS stripped FROM pages""")
def q_strip_comments_web(spark, sf_dir):
    """Comment stripping of URL + raw HTML (``//`` and ``#`` both occur)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", strip_comments(F.concat(F.col("url"), F.lit("\n"), F.col("html"))).alias("stripped"))


REFERENCE_CASES = ["&#8217;", "&#x2014;", "&#X2014;", "&eacute;", "&Eacute;t&eacute;", "&amp;lt;", "&amp;amp;", "&nosuch;", "&eacute", "&;", "&", "&&lt;&", "&#;",
                   "&#x;", "&#xZZ;", "&#0;", "&#128;", "&#x9F;", "&#129;", "&#55296;", "&#x10FFFF;", "&#x110000;", "&#999999999;", "&#9999999999;", "&#000000000000065;",
                   "&#x000000000000041;", "&nbsp;", "&#160;", "&#xA0;", "&apos;&#39;", "&quot;", "a&lt;b&gt;c", "&copy;&middot;", "&thetasym;", "&#128512;", "&#10;"]


@register("html_references", f"""SELECT page_id, {_references_sql('t')} AS text FROM (
  SELECT page_id, [{", ".join("'" + c + "'" for c in REFERENCE_CASES)}][page_id % {len(REFERENCE_CASES)} + 1] || ' ' || html AS t FROM pages)""")
def q_html_references(spark, sf_dir):
    """Character references decoded in every page, each with one of the hard cases in front."""
    cases = F.array(*map(F.lit, REFERENCE_CASES))
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", decode_references(F.concat(F.get(cases, (F.col("page_id") % len(REFERENCE_CASES)).cast("int")), F.lit(" "), F.col("html"))).alias("text"))


@register("html_text", f"""SELECT page_id, {_html_text_sql('html')} AS text FROM pages""")
def q_html_text(spark, sf_dir):
    """HTML to wrapped text for every page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", html_to_text(F.col("html")).alias("text"))


# ----------------------------------------------------------- step 8: history
HIST_SQL = """hist AS (SELECT user_id, trim(event_type || ' ' || props) AS command, ts, event_id AS seq FROM events WHERE event_type <> 'error'),
uses AS (SELECT user_id, command, max(ts) AS mts, arg_max(seq, (ts, seq)) AS last_seq FROM hist WHERE command <> '' GROUP BY user_id, command)"""


@register("recent_commands", f"""WITH {HIST_SQL}
SELECT user_id, CAST(rank AS INTEGER) AS rank, command, last_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mts DESC, last_seq DESC) AS rank FROM uses)
WHERE rank <= 50""")
def q_recent_commands(spark, sf_dir):
    """Most-recently-used commands per user, cap 50."""
    return history.recent_commands(views.history(spark, sf_dir)).select("user_id", "rank", "command", "last_seq")


LIST_SQL = f"""ev AS (
  SELECT user_id, event_type = 'error' AS forgets, CASE WHEN event_type = 'error' THEN 'view ' || props ELSE trim(event_type || ' ' || props) END AS command,
         event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
lists AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS l FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT s.user_id, e.rn, CASE WHEN e.forgets THEN list_filter(s.l, lambda x: x <> e.command)
                               ELSE list_concat([e.command], list_filter(s.l, lambda x: x <> e.command))[1:{MAX_HISTORY}] END
  FROM lists s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1),
final AS (
  SELECT user_id, unnest(l) AS command, unnest(generate_series(1, len(l))) AS rank
  FROM (SELECT user_id, arg_max(l, rn) AS l FROM lists GROUP BY user_id))"""


@register("forget_commands", f"""WITH RECURSIVE {LIST_SQL},
{HIST_SQL}
SELECT f.user_id, CAST(f.rank AS INTEGER) AS rank, f.command, u.last_seq FROM final f JOIN uses u USING (user_id, command)""")
def q_forget_commands(spark, sf_dir):
    """History with forgotten commands removed."""
    r = history.recent_commands(views.history(spark, sf_dir), forgets=views.forgets(spark, sf_dir))
    return r.select("user_id", "rank", "command", "last_seq")


EDGE_LIST_SQL = LIST_SQL.replace("trim(event_type || ' ' || props) END AS command", "CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || props END END AS command").replace(
    "event_id AS seq,", "event_id AS seq, event_type = 'error' AND event_id % 5 = 0 AS clears,").replace(
    "CASE WHEN e.forgets THEN", "CASE WHEN e.clears THEN CAST([] AS VARCHAR[]) WHEN e.command = '' THEN s.l WHEN e.forgets THEN")


@register("history_edges", f"""WITH RECURSIVE {EDGE_LIST_SQL}
SELECT user_id, CAST(rank AS INTEGER) AS rank, command FROM final""")
def q_history_edges(spark, sf_dir):
    """Blank commands and clear-alls among the edits."""
    h = views.history(spark, sf_dir).withColumn("command", F.when(F.col("seq") % 11 == 0, F.lit(" \t ")).otherwise(F.col("command")))
    f = views.forgets(spark, sf_dir).withColumn("command", F.when(F.col("seq") % 5 != 0, F.col("command")))
    return history.recent_commands(h, forgets=f).select("user_id", "rank", "command")


@register("history_read", f"""WITH {HIST_SQL}
SELECT user_id, CAST(rank AS INTEGER) AS rank, command, CAST(50 AS BIGINT) AS max FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mts DESC, last_seq DESC) AS rank FROM uses)
WHERE rank <= 50""")
def q_history_read(spark, sf_dir):
    """Saved histories written by the sink and read back."""
    from ctxloom.sources.files import write_history
    path = scratch_path(spark, "tables", f"history-{uuid.uuid4().hex[:12]}")
    write_history(history.history_json(history.recent_commands(views.history(spark, sf_dir))), path)
    docs = spark.read.text(path).select(F.from_json("value", "user_id long, json string").alias("d")).select("d.*")
    return history.read_history_json(docs).select("user_id", F.posexplode("commands").alias("rank", "command"), "max").withColumn("rank", F.col("rank") + 1)


@register("history_json", f"""WITH {HIST_SQL},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mts DESC, last_seq DESC) AS rank FROM uses) WHERE rank <= 50)
SELECT user_id, to_json({{'commands': list(command ORDER BY rank), 'max': CAST(50 AS BIGINT)}})::VARCHAR AS json
FROM ranked GROUP BY user_id""")
def q_history_json(spark, sf_dir):
    """History saved as one JSON document per user (S5 sink shape)."""
    return history.history_json(history.recent_commands(views.history(spark, sf_dir)))


@register("head_tail_lines", f"""WITH l AS (
  SELECT doc_id AS key, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS line_no, len(ls) AS total
  FROM (SELECT doc_id, {_rust_lines_sql('text')} AS ls FROM documents))
SELECT key, CAST(CASE WHEN total <= 5 OR line_no < 3 THEN line_no ELSE line_no - (total - 2) + 4 END AS BIGINT) AS pos, line
FROM l WHERE total <= 5 OR line_no < 3 OR line_no >= total - 2
UNION ALL
SELECT key, CAST(3 AS BIGINT), '[... output truncated ...]' FROM l WHERE total > 5 GROUP BY key""")
def q_head_tail_lines(spark, sf_dir):
    """First 3 and last 2 lines of every document, with the marker."""
    d = table(spark, sf_dir, "documents")
    return lines.head_tail_rows(d.select(F.col("doc_id").alias("key"), "text"), 3, 2)


@register("head_tail_text", f"""SELECT doc_id, {_head_tail_sql('text', 3, 2)} AS output FROM documents""")
def q_head_tail_text(spark, sf_dir):
    """Same cut on the text column, no shuffle."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", head_tail_text(F.col("text"), 3, 2).alias("output"))


# ------------------------------------------------------------ step 9: latest
UPDATES_SQL = f"""upd AS (
  SELECT regexp_extract(url, '{V.SCHEME}([^?#]*)', 1) AS url_key, html AS content, {V.EPOCH} + (page_id * 7919) % 10007 AS tsec, 2 * page_id AS seq
  FROM pages
  UNION ALL
  SELECT regexp_extract(url, '{V.SCHEME}([^?#]*)', 1), {_html_text_sql('html')}, {V.EPOCH} + (page_id * 6007) % 10007, 2 * page_id + 1
  FROM pages)"""


@register("latest_update", f"""WITH {UPDATES_SQL}
SELECT url_key, arg_max(content, (tsec, seq)) AS content, CAST(arg_max(seq, (tsec, seq)) AS BIGINT) AS last_seq, CAST(count(*) AS BIGINT) AS n_versions
FROM upd GROUP BY url_key""")
def q_latest_update(spark, sf_dir):
    """Newest content per URL key by (ts, seq) (J7); text is made for the winners only."""
    rows = updates.latest_rows(views.raw_updates(spark, sf_dir))
    return updates.latest_content(rows.withColumn("content", views.update_content()), "url_key")


@register("repeated_updates", f"""WITH upd AS (
  SELECT CASE WHEN page_id % 41 <> 0 THEN regexp_extract(url, '{V.SCHEME}([^/?#]*)', 1) END AS url_key, url || ' ' || html AS content,
         CASE WHEN page_id % 13 <> 0 THEN {V.EPOCH} + page_id * 7919 % 5 END AS tsec, page_id % 50 AS seq,
         unnest(CASE WHEN page_id % 7 = 0 THEN [0, 0] ELSE [0] END) AS copy
  FROM pages)
SELECT url_key, content, CAST(seq AS BIGINT) AS last_seq, n_versions
FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY tsec DESC NULLS LAST, seq DESC, content DESC) AS rn,
             count(*) OVER (PARTITION BY url_key) AS n_versions FROM upd) WHERE rn = 1""")
def q_repeated_updates(spark, sf_dir):
    """Newest content per key where records repeat, share numbers and miss keys and times."""
    return updates.latest_by_key(views.repeated_updates(spark, sf_dir))


NEAREST_SQL = f"""{V.PROJECTS},
roots AS (SELECT project_id, k, lang, '/ws/' || lang || '/' || project_id AS root FROM projects),
langs AS (SELECT DISTINCT lang FROM documents),
rule_files AS (
  SELECT root || '/{NAMES.rule_file}' AS path, project_id AS owner FROM roots WHERE k % 4 = 0
  UNION ALL SELECT root || '/{NAMES.rule_file_legacy}', project_id FROM roots WHERE k % 4 IN (0, 1)
  UNION ALL SELECT '/ws/' || lang || '/{NAMES.rule_file}', NULL FROM langs WHERE lang IN ('en', 'fr')),
rf AS (SELECT path, ends_with(path, '/{NAMES.rule_file}') AS is_new,
              regexp_replace(path, '/(?:{re.escape(NAMES.rule_file)}|{re.escape(NAMES.rule_file_legacy)})$', '') AS dir FROM rule_files),
up AS (
  SELECT project_id, depth, '/' || array_to_string(segs[1:depth], '/') AS dir
  FROM (SELECT project_id, segs, unnest(generate_series(len(segs), 0, -1)) AS depth
        FROM (SELECT project_id, list_filter(string_split(root, '/'), lambda s: s <> '') AS segs FROM roots))),
best AS (
  SELECT * FROM (SELECT up.project_id, rf.dir, rf.path, rf.is_new,
                        row_number() OVER (PARTITION BY up.project_id ORDER BY up.depth DESC, rf.is_new DESC) AS rn
                 FROM up JOIN rf USING (dir)) WHERE rn = 1),
nearest AS (SELECT r.project_id, r.k, r.lang, b.dir AS rule_dir, b.path AS rule_path, b.is_new
            FROM roots r LEFT JOIN best b USING (project_id))"""


@register("nearest_rules", f"""WITH {NEAREST_SQL}
SELECT project_id, rule_dir, rule_path FROM nearest""")
def q_nearest_rules(spark, sf_dir):
    """Nearest rule file from each project root upward."""
    from ctxloom.operators.rules import nearest_rule_file
    roots, files = C.workspace(spark, sf_dir)
    return nearest_rule_file(roots, files).select("project_id", "rule_dir", "rule_path")


@register("project_scan_stats", f"""WITH {V.DOCS},
{NEAREST_SQL},
prx AS (
  SELECT project_id,
    CASE
      WHEN rule_path IS NULL THEN '{DEFAULT_RX_SQL}'
      WHEN is_new AND rule_dir <> '/ws/' || lang THEN
        '(?:.*' || replace(['.rs','.md','.txt','.cu','.cuda','.o','.py','.html','.css','.csv','.slang','.wgsl','.png','.exr','.hdr','.jpg','.jpeg','.gltf','.glb','.spv','.spvasm','.glsl','.comp','.sh','.lock','.toml'][k % 26 + 1], '.', '\\.')
        || '|(.*/)?' || lang || '/' || CAST(k % 3 AS VARCHAR) || '(/.*)?)'
      WHEN NOT is_new THEN '(?:.*\\.tmp|(.*/)?' || lang || '/' || CAST((k + 1) % 3 AS VARCHAR) || ')'
      WHEN lang = 'fr' THEN '(?:.*\\.md)'
      ELSE NULL END AS rx
  FROM nearest),
pre AS (SELECT d.*, p.rx, {V.prefixes('d.rel_path')} AS prefixes FROM docs d LEFT JOIN prx p USING (project_id)),
marked AS (
  SELECT *, CASE WHEN hit IS NOT NULL AND hit <> prefixes[len(prefixes)] THEN hit END AS dir_hit
  FROM (SELECT *, CASE WHEN rx IS NULL THEN NULL ELSE list_filter(prefixes, lambda p: regexp_full_match(p, rx))[1] END AS hit FROM pre))
{_stats_sql(MAX_FILES)}""")
def q_project_scan_stats(spark, sf_dir):
    """Per-project rule files (nearest wins, unreadable -> defaults) compiled
    and applied, then scan statistics (J3, S3, F2, F1, A1)."""
    from ctxloom.operators.rules import compile_project_rules, nearest_rule_file
    roots, files = C.workspace(spark, sf_dir)
    chosen = nearest_rule_file(roots, files).where(F.col("rule_path").isNotNull()).select("project_id", "text")
    compiled = compile_project_rules(roots.select("project_id"), chosen)
    marked = scan.mark_hits(views.docs_meta(spark, sf_dir), compiled)
    return scan.scan_stats(marked)


# --------------------------------------------------------- streaming
@register("stream_latest_update", ORACLE_SQL["latest_update"])
def q_stream_latest_update(spark, sf_dir):
    """The update stream replayed as 8 file arrivals; equals ``latest_update``."""
    from ctxloom.plans.replay import stage_arrivals
    from ctxloom.streaming import jobs
    upd = views.updates(spark, sf_dir)
    path = stage_arrivals(upd, "seq", 8, "updates")
    return jobs.latest_content(spark, path, upd.schema, max_files=1)


@register("stream_recent_commands", ORACLE_SQL["recent_commands"])
def q_stream_recent_commands(spark, sf_dir):
    """Command uses replayed as 8 file arrivals; equals ``recent_commands``."""
    from ctxloom.plans.replay import stage_arrivals
    from ctxloom.streaming import jobs
    h = views.history(spark, sf_dir)
    path = stage_arrivals(h, "seq", 8, "history")
    return jobs.recent_commands(spark, path, h.schema, max_files=1)


@register("stream_file_estimate", f"""WITH {DOCS_LOADED},
{SELECTION_SQL},
{ACTIONS_SQL}
SELECT project_id, CAST(count(*) AS BIGINT) AS n_files,
  CAST(sum(CASE WHEN selected THEN {V.file_tokens('length')} ELSE 0 END) AS BIGINT) AS file_tokens,
  CAST(ceil(CAST(sum(strlen(rel_path) + 4) + 16 AS FLOAT) / 4) AS BIGINT) AS tree_tokens
FROM ticked GROUP BY project_id""")
def q_stream_file_estimate(spark, sf_dir):
    """Loaded files with ticks arriving in 8 batches; running estimate parts."""
    from ctxloom.plans.replay import stage_arrivals
    from ctxloom.streaming import jobs
    state = C.docs_selected_state(spark, sf_dir).select("project_id", "rel_path", "length", "selected", "doc_id")
    path = stage_arrivals(state, "doc_id", 8, "files")
    return jobs.running_estimate(spark, path, state.schema, max_files=1)


@register("stream_history_list", f"""WITH RECURSIVE {LIST_SQL}
SELECT user_id, CAST(rank AS INTEGER) AS rank, command FROM final""")
def q_stream_history_list(spark, sf_dir):
    """Exact history lists (add / forget in event order, cap 50) from the
    ``events`` stream; stateful per user."""
    from ctxloom.plans.replay import stage_arrivals
    from ctxloom.streaming import history_list
    ev = history_list.history_events(views.history(spark, sf_dir), views.forgets(spark, sf_dir))
    path = stage_arrivals(ev, "seq", 8, "history-events", ordered=True)
    return history_list.history_lists(spark, path, ev.schema, max_files=1)


@register("conversation_head_tail", f"""WITH t AS (
  SELECT conv_id, turn, {_rust_lines_sql('text')} AS ls FROM conversations),
l AS (
  SELECT conv_id AS key, turn, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS pos,
         coalesce(sum(len(ls)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM t),
n AS (SELECT key, off + pos AS line_no, line, count(*) OVER (PARTITION BY key) AS total FROM l)
SELECT key, CAST(CASE WHEN total <= 5 OR line_no < 3 THEN line_no ELSE line_no - (total - 2) + 4 END AS BIGINT) AS pos, line
FROM n WHERE total <= 5 OR line_no < 3 OR line_no >= total - 2
UNION ALL
SELECT key, CAST(3 AS BIGINT), '[... output truncated ...]' FROM n WHERE total > 5 GROUP BY key""")
def q_conversation_head_tail(spark, sf_dir):
    """First 3 and last 2 lines of each conversation, turns in order (L5 over
    ordered fragments)."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("key"), F.col("turn").alias("part"), "text")
    return lines.head_tail_parts(c, 3, 2)
