"""Queries over the change set of a commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.case import Tables, case
from contract.text_cases import MANIFEST_COUNTS
from runlore.functions import files
from runlore.operators import changes, commits, linediff, repositories

_PRODUCTION = "'" + "|".join(s.replace(".", "\\.") for s in files.PRODUCTION_SUFFIXES) + "'"
_DOC_DIRECTORIES = "[" + ", ".join(f"'{d}'" for d in files.DOC_DIRECTORIES) + "]"
_CONFIG = " OR ".join(f"contains({{0}}, '{m}')" for m in files.CONFIG_MARKS)


def kind(path: str) -> str:
    return f"""CASE WHEN contains(lower({path}), 'test') OR contains(lower({path}), 'spec') THEN 'test'
  WHEN regexp_matches({path}, '(' || {_PRODUCTION} || ')$') THEN 'production'
  WHEN regexp_matches(lower({path}), '\\.(md|rst|txt|pdf)$') THEN 'doc'
  WHEN ends_with(lower({path}), '.html') AND len(list_filter({_DOC_DIRECTORIES}, lambda d: contains(lower({path}), d))) > 0 THEN 'doc'
  WHEN list_has_any(string_split(lower({path}), '/'), {_DOC_DIRECTORIES}) THEN 'doc'
  WHEN {_CONFIG.format(path)} THEN 'config' ELSE 'other' END"""


_NAME = "string_split(filename, '/')[-1]"
SUFFIX = f"CASE WHEN regexp_matches({_NAME}, '^.+\\.[^.]+$') THEN lower('.' || string_split({_NAME}, '.')[-1]) ELSE '' END"


def _lines(mark: str, header: str) -> str:
    return f"len(list_filter(string_split(patch, chr(10)), lambda l: starts_with(l, '{mark}') AND NOT starts_with(l, '{header}')))"


FILES = f"""
SELECT repository, sha, filename, status, {kind('filename')} AS kind, {SUFFIX} AS suffix, split_part(filename, '/', 1) AS top,
  {_lines('+', '+++')} AS added, {_lines('-', '---')} AS deleted FROM {{commit_files}}"""

DIFF = f"""
WITH f AS ({FILES}),
e AS (SELECT repository, sha, round(greatest(-sum(p * log2(p)), 0), 3) + 0.0 AS gh_files_entropy FROM (
  SELECT repository, sha, suffix, count(*) / sum(count(*)) OVER (PARTITION BY repository, sha) AS p FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT f.repository, f.sha, count(*) FILTER (status = 'A') AS gh_files_added, count(*) FILTER (status = 'D') AS gh_files_deleted,
  count(*) FILTER (status NOT IN ('A', 'D')) AS gh_files_modified, CAST(sum(added) AS BIGINT) AS gh_lines_added, CAST(sum(deleted) AS BIGINT) AS gh_lines_deleted,
  CAST(sum(CASE WHEN kind = 'test' THEN added ELSE 0 END) AS BIGINT) AS gh_tests_added,
  CAST(sum(CASE WHEN kind = 'test' THEN deleted ELSE 0 END) AS BIGINT) AS gh_tests_deleted,
  CAST(sum(CASE WHEN kind = 'test' THEN added + deleted ELSE 0 END) AS BIGINT) AS gh_test_churn,
  count(*) FILTER (kind = 'production') AS gh_src_files, CAST(sum(CASE WHEN kind = 'production' THEN added + deleted ELSE 0 END) AS BIGINT) AS gh_src_churn,
  count(*) FILTER (kind = 'doc') AS gh_doc_files, count(*) FILTER (kind = 'config') AS gh_config_files, count(*) FILTER (kind = 'other') AS gh_other_files,
  count(DISTINCT suffix) AS gh_files_type_modified, any_value(e.gh_files_entropy) AS gh_files_entropy,
  CAST(count(DISTINCT top) > 1 AS BIGINT) AS gh_cross_module_changes,
  CAST(bool_or(contains(filename, 'dockerfile')) AS BIGINT) AS dockerfile_changed,
  CAST(bool_or(contains(filename, 'docker-compose') AND NOT contains(filename, 'dockerfile')) AS BIGINT) AS docker_compose_changed
FROM f JOIN e ON e.repository = f.repository AND e.sha = f.sha GROUP BY 1, 2"""

_PAIRS = "SELECT repository, sha AS head, parent_sha AS base FROM {commits} WHERE parent_sha IS NOT NULL"

_SYMBOLS = f"""
p AS ({_PAIRS}),
ch AS (SELECT DISTINCT f.repository, f.sha AS head, p.base, f.filename AS path FROM {{commit_files}} f JOIN p ON p.repository = f.repository AND p.head = f.sha WHERE f.filename LIKE '%.java'),
last AS (SELECT repository, sha, path, kind, coalesce(class_name, '') AS class_name, name, arg_max(signature, position) AS signature, arg_max(body_hash, position) AS body
  FROM {{java_symbols}} GROUP BY ALL),
o AS (SELECT c.repository, c.head, c.path, l.* EXCLUDE (repository, sha, path) FROM ch c JOIN last l ON l.repository = c.repository AND l.sha = c.base AND l.path = c.path),
n AS (SELECT c.repository, c.head, c.path, l.* EXCLUDE (repository, sha, path) FROM ch c JOIN last l ON l.repository = c.repository AND l.sha = c.head AND l.path = c.path),
both_sides AS (SELECT repository, head, path, kind, class_name, name, o.name IS NOT NULL AS was, n.name IS NOT NULL AS is_now, o.signature AS s0, n.signature AS s1, o.body AS b0, n.body AS b1
  FROM (SELECT *, 1 AS k FROM o) o FULL JOIN (SELECT *, 1 AS k FROM n) n USING (repository, head, path, kind, class_name, name)),
common AS (SELECT repository, head, path, name AS class_name FROM both_sides WHERE kind = 'class' AND was AND is_now),
counted AS (SELECT b.*, c.class_name IS NOT NULL AS in_common FROM both_sides b LEFT JOIN common c
  ON c.repository = b.repository AND c.head = b.head AND c.path = b.path AND c.class_name = b.class_name),
per_file AS (SELECT repository, head, path,
  count(*) FILTER (kind = 'class' AND is_now AND NOT was) AS ca, count(*) FILTER (kind = 'class' AND was AND NOT is_now) AS cd, count(*) FILTER (kind = 'class' AND was AND is_now) AS cm,
  count(*) FILTER (kind = 'method' AND in_common AND is_now AND NOT was) AS ma, count(*) FILTER (kind = 'method' AND in_common AND was AND NOT is_now) AS md,
  count(*) FILTER (kind = 'method' AND in_common AND was AND is_now AND s0 <> s1) AS ms, count(*) FILTER (kind = 'method' AND in_common AND was AND is_now AND s0 = s1 AND b0 <> b1) AS mb,
  count(*) FILTER (kind = 'field' AND in_common AND is_now AND NOT was) AS fa, count(*) FILTER (kind = 'field' AND in_common AND was AND NOT is_now) AS fd,
  count(*) FILTER (kind = 'import' AND is_now AND NOT was) AS ia, count(*) FILTER (kind = 'import' AND was AND NOT is_now) AS id
  FROM counted GROUP BY ALL)"""


def _sum(expression: str, name: str) -> str:
    return f"CAST(sum({expression}) AS BIGINT) AS {name}"


SYMBOLS = f"""
WITH {_SYMBOLS}
SELECT repository, head AS sha, {_sum('ca', 'ast_class_added')}, {_sum('cd', 'ast_class_deleted')}, {_sum('cm', 'ast_class_modified')}, {_sum('ca + cd + cm', 'ast_class_changed')},
  {_sum('ma', 'ast_met_added')}, {_sum('md', 'ast_met_deleted')}, {_sum('ma + md', 'ast_met_changed')}, {_sum('ms', 'ast_met_sig_modified')}, {_sum('mb', 'ast_met_body_modified')},
  {_sum('fa', 'ast_field_added')}, {_sum('fd', 'ast_field_deleted')}, {_sum('fa + fd', 'ast_field_changed')},
  {_sum('ia', 'ast_import_added')}, {_sum('id', 'ast_import_deleted')}, {_sum('ia + id', 'ast_import_changed')},
  CAST(max(CASE WHEN ca + cd + cm + ma + md > 0 AND {kind('path')} = 'production' THEN 1 ELSE 0 END) AS BIGINT) AS src_ast_diff,
  CAST(max(CASE WHEN ca + cd + cm + ma + md > 0 AND {kind('path')} = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test_ast_diff
FROM per_file GROUP BY ALL"""

DEPENDENCIES = f"""
WITH m AS ({MANIFEST_COUNTS}), p AS ({_PAIRS})
SELECT p.repository, p.head AS sha, count(*) FILTER (a.n <> b.n) AS gh_dependencies_churn, CAST(sum(a.n) AS BIGINT) AS dependencies_count
FROM p JOIN m a ON a.repository = p.repository AND a.sha = p.head
LEFT JOIN m b ON b.repository = p.repository AND b.sha = p.base AND b.path = a.path GROUP BY 1, 2"""


def _zero(columns: str, alias: str) -> str:
    return ", ".join(f"coalesce({alias}.{c}, 0) AS {c}" for c in columns.split())


DIFF_COLUMNS = (
    "gh_files_added gh_files_deleted gh_files_modified gh_lines_added gh_lines_deleted gh_tests_added gh_tests_deleted gh_test_churn"
    " gh_src_files gh_src_churn gh_doc_files gh_config_files gh_other_files gh_files_type_modified gh_files_entropy"
    " gh_cross_module_changes dockerfile_changed docker_compose_changed"
)
SYMBOL_COLUMNS = (
    "ast_class_added ast_class_deleted ast_class_modified ast_class_changed ast_met_added ast_met_deleted ast_met_changed"
    " ast_met_sig_modified ast_met_body_modified ast_field_added ast_field_deleted ast_field_changed ast_import_added"
    " ast_import_deleted ast_import_changed src_ast_diff test_ast_diff"
)
CHANGES = f"""
SELECT p.repository, p.head AS sha, {_zero(DIFF_COLUMNS, 'd')}, {_zero(SYMBOL_COLUMNS, 's')}, {_zero('gh_dependencies_churn dependencies_count', 'x')}
FROM ({_PAIRS}) p LEFT JOIN ({DIFF}) d ON d.repository = p.repository AND d.sha = p.head
LEFT JOIN ({SYMBOLS}) s ON s.repository = p.repository AND s.sha = p.head
LEFT JOIN ({DEPENDENCIES}) x ON x.repository = p.repository AND x.sha = p.head"""

SIZE = """
WITH s AS (SELECT repository, sha, CAST(sum(code_lines) AS BIGINT) AS sloc,
  CAST(coalesce(sum(total_lines) FILTER (lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%'), 0) AS BIGINT) AS tests FROM {file_metrics} GROUP BY 1, 2)
SELECT repository, sha, sloc AS gh_sloc, round(CASE WHEN sloc <> 0 THEN tests / sloc * 1000 END, 6) AS gh_test_lines_per_kloc,
  sloc AS sloc_initial, tests AS test_lines_initial FROM s"""

BASE = """
SELECT r.repository, r.run_id, c.parent_sha AS base_sha FROM {runs} r LEFT JOIN {commits} c ON c.repository = r.repository AND c.sha = r.head_sha"""

SAME_FILES = """
WITH p AS (SELECT repository, run_id, head_sha, lag(head_sha) OVER (PARTITION BY repository, head_branch ORDER BY created_at, run_id) AS prev FROM {runs}),
q AS (SELECT DISTINCT repository, head_sha, prev FROM p JOIN {commits} a USING (repository) WHERE a.sha = head_sha
  AND prev IN (SELECT sha FROM {commits} b WHERE b.repository = p.repository)),
s AS (SELECT DISTINCT q.repository, q.head_sha, q.prev FROM q JOIN {commit_files} a ON a.repository = q.repository AND a.sha = q.head_sha
  JOIN {commit_files} b ON b.repository = q.repository AND b.sha = q.prev AND b.filename = a.filename)
SELECT p.repository, p.run_id, CASE WHEN q.prev IS NOT NULL THEN s.prev IS NOT NULL END AS prev_build_same_files_touched
FROM p LEFT JOIN q ON q.repository = p.repository AND q.head_sha = p.head_sha AND q.prev = p.prev
LEFT JOIN s ON s.repository = p.repository AND s.head_sha = p.head_sha AND s.prev = p.prev"""

CI_CHURN = """
WITH e AS (SELECT c.repository, epoch_us(c.committed_at) // 86400000000 AS d FROM {commits} c JOIN {commit_files} f
  ON f.repository = c.repository AND f.sha = c.sha WHERE regexp_matches(f.filename, '^\\.github/workflows/.*?\\.(yaml|yml)')),
k AS (SELECT repository, d, count(*) AS n FROM e GROUP BY 1, 2)
SELECT r.repository, r.run_id, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS repo_ci_config_churn_nums
FROM {runs} r LEFT JOIN k ON k.repository = r.repository
  AND k.d BETWEEN epoch_us(r.created_at) // 86400000000 - 28 AND epoch_us(r.created_at) // 86400000000 GROUP BY 1, 2"""


@case("d01_file_kind", FILES)
def _(t: Tables):
    return changes.classified_files(t["commit_files"])


@case("d02_d08_diff_stats", DIFF)
def _(t: Tables):
    return changes.diff_stats(t["commit_files"])


@case("d09_d10_symbol_diff", SYMBOLS)
def _(t: Tables):
    return changes.symbol_diff(t["commits"], t["commit_files"], t["java_symbols"])


@case("d11_dependency_changes", DEPENDENCIES)
def _(t: Tables):
    return changes.dependency_changes(t["commits"], repositories.manifest_counts(t["file_contents"]))


@case("d12_commit_change_features", CHANGES)
def _(t: Tables):
    counts = repositories.manifest_counts(t["file_contents"])
    return changes.commit_change_features(t["commits"], t["commit_files"], t["java_symbols"], counts)


@case("c27_code_size", SIZE)
def _(t: Tables):
    return repositories.code_size(t["file_metrics"])


_LINES = "regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\x{2028}\\x{2029}]')"


@case("c27_lines_from_contents", f"""
WITH l AS (SELECT repository, sha, path, CASE WHEN {_LINES}[-1] = '' THEN {_LINES}[1 : len({_LINES}) - 1] ELSE {_LINES} END AS lines FROM {{file_contents}}),
k AS (SELECT *, path LIKE '%.yml' OR path = 'Gemfile' AS hashes FROM l)
SELECT repository, sha, path, CASE WHEN path LIKE '%.yml' THEN 'YAML' WHEN path = 'Gemfile' THEN 'Gemfile' WHEN path LIKE '%.json' THEN 'JSON' WHEN path LIKE '%.txt' THEN 'Plain Text'
    WHEN path LIKE '%.gradle' THEN 'Gradle' WHEN path LIKE '%.kts' THEN 'Kotlin' ELSE 'XML' END AS language,
  coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '\\S') AND NOT (hashes AND regexp_matches(x, '^\\s*#')))), 0) AS code_lines,
  coalesce(len(list_filter(lines, lambda x: hashes AND regexp_matches(x, '^\\s*#'))), 0) AS comment_lines,
  coalesce(len(list_filter(lines, lambda x: NOT regexp_matches(x, '\\S'))), 0) AS blank_lines, coalesce(len(lines), 0) AS total_lines
FROM k""")
def _(t: Tables):
    return repositories.content_metrics(t["file_contents"])


@case("c26_base_commit", BASE)
def _(t: Tables):
    return commits.base_commit(t["runs"], t["commits"])


@case("c19_same_files_as_previous", SAME_FILES)
def _(t: Tables):
    return commits.same_files_as_previous(t["runs"], t["commits"], t["commit_files"])


@case("c19_same_files_as_previous_split", SAME_FILES)
def _(t: Tables):
    return commits.same_files_as_previous(t["runs"], t["commits"], t["commit_files"], target_rows=50)


@case("c24_ci_config_churn", CI_CHURN)
def _(t: Tables):
    return commits.ci_config_churn(t["runs"], t["commits"], t["commit_files"])


@case("c24_ci_config_churn_split", CI_CHURN)
def _(t: Tables):
    return commits.ci_config_churn(t["runs"], t["commits"], t["commit_files"], target_rows=20)


def _lines(text: str) -> str:
    body = f"CASE WHEN ends_with({text}, chr(10)) THEN left({text}, length({text}) - 1) ELSE {text} || chr(1) END"
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN [] ELSE string_split({body}, chr(10)) END"


# longest common subsequences by rows of the table of all prefixes, one old line after the other
CONTENT_CHANGES = f"""
SELECT * FROM (WITH RECURSIVE pairs AS (SELECT repository, sha, parent_sha FROM {{commits}} WHERE parent_sha IS NOT NULL),
h AS (SELECT p.repository, p.sha, f.path AS filename, f.content AS new, true AS is_new FROM pairs p
  JOIN {{file_contents}} f ON f.repository = p.repository AND f.sha = p.sha),
o AS (SELECT p.repository, p.sha, f.path AS filename, f.content AS old, true AS is_old FROM pairs p
  JOIN {{file_contents}} f ON f.repository = p.repository AND f.sha = p.parent_sha),
changed AS (SELECT * FROM h FULL JOIN o USING (repository, sha, filename)
  WHERE is_new IS NULL OR is_old IS NULL OR new IS DISTINCT FROM old),
texts AS (SELECT DISTINCT old, new, {_lines('old')} AS a, {_lines('new')} AS b FROM changed WHERE is_old AND is_new),
step AS (
  SELECT old, new, a, b, 0 AS i, list_transform(b, lambda x: 0) AS row FROM texts
  UNION ALL
  SELECT old, new, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    greatest(row[k], CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END + CASE WHEN b[k] = a[i + 1] THEN 1 ELSE 0 END))))
  FROM step WHERE i < len(a)),
common AS (SELECT old, new, coalesce(row[len(b)], 0) AS same FROM step WHERE i = len(a))
SELECT repository, sha, filename, CASE WHEN is_old IS NULL THEN 'A' WHEN is_new IS NULL THEN 'D' ELSE 'M' END AS status,
  CAST(len({_lines('c.new')}) - coalesce(m.same, 0) AS BIGINT) AS added, CAST(len({_lines('c.old')}) - coalesce(m.same, 0) AS BIGINT) AS deleted
FROM changed c LEFT JOIN common m ON c.is_old AND c.is_new AND m.old IS NOT DISTINCT FROM c.old AND m.new IS NOT DISTINCT FROM c.new) f"""


@case("d03_lines_from_contents", CONTENT_CHANGES)
def _(t: Tables):
    return linediff.content_changes(t["commits"], t["file_contents"])


@case("d01_d04_stats_from_contents", f"""
SELECT repository, sha, count(*) FILTER (status = 'A') AS gh_files_added, count(*) FILTER (status = 'D') AS gh_files_deleted,
  count(*) FILTER (status = 'M') AS gh_files_modified, CAST(sum(added) AS BIGINT) AS gh_lines_added, CAST(sum(deleted) AS BIGINT) AS gh_lines_deleted
FROM ({CONTENT_CHANGES}) c GROUP BY 1, 2""")
def _(t: Tables):
    stats = changes.diff_stats(linediff.content_changes(t["commits"], t["file_contents"]))
    return stats.select("repository", "sha", "gh_files_added", "gh_files_deleted", "gh_files_modified", "gh_lines_added", "gh_lines_deleted")
