"""Independent SQL for the registered queries, over the same parquet tables."""

from __future__ import annotations

REPOSITORY = r"""repository AS (
  SELECT c_custkey AS id, c_name AS name,
         'https://github.com/' || lower(c_mktsegment) || '/' || replace(c_name, '#', '-') || '.git' AS url,
         'main' AS primary_branch, md5(CAST(c_custkey AS VARCHAR)) AS last_commit_hash,
         c_nationkey < 12 AS needs_scan, c_acctbal > 0 AS periodic_scan_enabled,
         c_nationkey * 86400 * 30 AS periodic_scan_interval,
         CASE c_mktsegment WHEN 'BUILDING' THEN '*.rs, p1*' WHEN 'MACHINERY' THEN 'src' END AS sast_exclusions
  FROM customer)"""

SCAN = r"""scan AS (
  SELECT o_orderkey AS id, o_custkey AS repository_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'deep' WHEN '2-HIGH' THEN 'commit' WHEN '3-MEDIUM' THEN 'test'
              WHEN '4-NOT SPECIFIED' THEN 'cve-linking' WHEN '5-LOW' THEN 'quality' END AS scan_type,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' END AS status,
         CASE WHEN o_orderpriority <> '5-LOW' THEN 'job-' || o_orderkey END AS job_id,
         CASE WHEN o_orderstatus <> 'F' THEN 'main' END AS branch,
         CASE WHEN o_orderpriority = '2-HIGH' THEN md5(CAST(o_orderkey AS VARCHAR)) END AS triggering_commit_hash,
         CAST(o_orderkey % 50 AS INTEGER) AS progress, CAST(o_custkey % 4 * 20 AS INTEGER) AS total_progress,
         o_orderdate AS created_at,
         CASE o_orderkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['Python'] WHEN 2 THEN ['Go', 'Python'] END AS languages
  FROM orders)"""

_LINE_ID = (
    "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),"
    " CAST(round(l_extendedprice * 100) AS BIGINT)))"
)
_LINE_PATH = (
    "'src/f' || (l_partkey % 97) || CASE l_linenumber WHEN 1 THEN '.py' WHEN 2 THEN '.js' WHEN 3 THEN '.go'"
    " WHEN 4 THEN '.rb' WHEN 5 THEN '.rs' WHEN 6 THEN '.TS' ELSE '.md' END"
)
_SEVERITY = (
    "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'CRITICAL' WHEN 'AO' THEN 'HIGH' WHEN 'NF' THEN 'MEDIUM'"
    " WHEN 'NO' THEN 'MEDIUM' WHEN 'RF' THEN 'LOW' ELSE 'UNKNOWN' END"
)
RAW_LEVEL = (
    "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'critical' WHEN 'AO' THEN 'error' WHEN 'NF' THEN 'warning'"
    " WHEN 'NO' THEN 'Medium' WHEN 'RF' THEN 'info' ELSE 'Weak' END"
)

FINDINGS = rf"""findings AS (
  SELECT {_LINE_ID} AS id, l_orderkey AS scan_id, {_LINE_PATH} AS file_path, l_linenumber AS line_number,
         p_type AS code_snippet,
         CASE l_suppkey % 3
              WHEN 0 THEN 'semgrep: ' || p_name || ' (https://semgrep.dev/r/' || p_brand || ')'
              WHEN 1 THEN 'bandit: ' || p_name || ' (https://bandit.readthedocs.io/en/latest/plugins/' || p_brand || '.html)'
              ELSE 'Gitleaks: ' || p_name END AS description,
         {_SEVERITY} AS severity, l_discount * 10 AS confidence_score, 'new' AS status,
         CASE WHEN p_size > 40 THEN 'CVE-' || p_partkey END AS cve_id,
         CASE l_suppkey % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'bandit' ELSE 'gitleaks' END AS tool,
         p_brand || '/' || p_size AS package
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

METRIC = rf"""quality_metric AS (
  SELECT {_LINE_ID} AS id, l_orderkey AS scan_id, {_LINE_PATH} AS file_path, l_linenumber AS cyclomatic_complexity,
         CAST(l_quantity AS INTEGER) AS sloc, l_extendedprice / 1000 AS maintainability_index,
         l_tax * 100 AS code_coverage
  FROM lineitem WHERE l_linestatus = 'O')"""

LATEST = r"""latest AS (SELECT repository_id, max(id) AS scan_id FROM scan {where} GROUP BY repository_id)"""
_NON_QUALITY = LATEST.format(where="WHERE scan_type <> 'quality'")
_ANY = LATEST.format(where="")
_QUALITY = LATEST.format(where="WHERE scan_type = 'quality'")

# The language of the hosted paths: .TS and .md are unknown (suffixes are case-sensitive).
LANGUAGE = (
    "CASE regexp_extract(file_path, '\\.[^.]*$') WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript'"
    " WHEN '.go' THEN 'Go' WHEN '.rb' THEN 'Ruby' WHEN '.rs' THEN 'Rust' END"
)


def _half_up(expression: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


DASHBOARD = {
    "findings_by_severity": _with(SCAN, FINDINGS, _NON_QUALITY)
    + """SELECT severity, count(*) AS finding_count FROM findings JOIN latest USING (scan_id) GROUP BY severity""",
    "findings_by_repository": _with(REPOSITORY, SCAN, FINDINGS, _NON_QUALITY)
    + """SELECT r.id AS repository_id, name, count(*) AS finding_count
FROM findings JOIN latest USING (scan_id) JOIN repository r ON r.id = repository_id GROUP BY r.id, name""",
    "languages_by_repository": _with(REPOSITORY, SCAN, _ANY)
    + """SELECT r.id AS repository_id, name, array_to_string(languages, ',') AS languages
FROM latest JOIN scan s ON s.id = scan_id JOIN repository r ON r.id = s.repository_id WHERE len(languages) > 0""",
    "findings_by_language": _with(SCAN, FINDINGS, _NON_QUALITY)
    + f"""SELECT {LANGUAGE} AS language, count(*) AS finding_count FROM findings JOIN latest USING (scan_id)
GROUP BY 1 HAVING language IS NOT NULL""",
    "findings_by_repository_language": _with(REPOSITORY, SCAN, FINDINGS, _NON_QUALITY)
    + f"""SELECT r.id AS repository_id, name, {LANGUAGE} AS language, count(*) AS finding_count
FROM findings JOIN latest USING (scan_id) JOIN repository r ON r.id = repository_id
GROUP BY 1, 2, 3 HAVING language IS NOT NULL""",
    "headline_counters": _with(REPOSITORY, SCAN, FINDINGS, _NON_QUALITY)
    + """SELECT (SELECT count(*) FROM repository) AS total_repos, (SELECT count(*) FROM scan) AS total_scans,
       (SELECT count(*) FROM findings JOIN latest USING (scan_id)) AS total_findings""",
    "quality_by_repository": _with(REPOSITORY, SCAN, METRIC, _QUALITY)
    + f"""SELECT r.id AS repository_id, name, {_half_up("coalesce(avg(maintainability_index), 0)")} AS avg_maintainability,
       {_half_up("coalesce(max(code_coverage), 0)")} AS code_coverage
FROM quality_metric JOIN latest USING (scan_id) JOIN repository r ON r.id = repository_id GROUP BY r.id, name""",
    "finding_density": _with(
        REPOSITORY,
        SCAN,
        FINDINGS,
        METRIC,
        _ANY,
        """f AS (SELECT scan_id, count(*) AS n, sum(CASE severity WHEN 'HIGH' THEN 1 ELSE 0 END) AS h,
       sum(CASE severity WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS m, sum(CASE severity WHEN 'LOW' THEN 1 ELSE 0 END) AS l
  FROM findings GROUP BY scan_id)""",
        "q AS (SELECT scan_id, sum(sloc) AS sloc FROM quality_metric GROUP BY scan_id)",
    )
    + f"""SELECT r.id AS repository_id, name, CAST(sloc AS BIGINT) AS total_sloc,
       CAST(coalesce(n, 0) AS BIGINT) AS total_vulnerabilities, CAST(coalesce(h, 0) AS BIGINT) AS high_vulnerabilities,
       CAST(coalesce(m, 0) AS BIGINT) AS medium_vulnerabilities, CAST(coalesce(l, 0) AS BIGINT) AS low_vulnerabilities,
       CASE WHEN sloc > 0 THEN printf('%.2f', {_half_up("coalesce(n, 0) / sloc * 1000")}) ELSE 'N/A' END AS per_1000_lines
FROM latest JOIN repository r ON r.id = repository_id LEFT JOIN f USING (scan_id) LEFT JOIN q USING (scan_id)""",
    "finding_density_fan_out": _with(
        REPOSITORY,
        SCAN,
        FINDINGS,
        METRIC,
        _ANY,
        """j AS (SELECT r.name, sum(q.sloc) AS sloc, count(f.id) AS n,
       sum(CASE WHEN f.severity = 'HIGH' THEN 1 ELSE 0 END) AS h,
       sum(CASE WHEN f.severity = 'MEDIUM' THEN 1 ELSE 0 END) AS m,
       sum(CASE WHEN f.severity = 'LOW' THEN 1 ELSE 0 END) AS l
  FROM repository r JOIN latest ON r.id = repository_id LEFT JOIN findings f ON f.scan_id = latest.scan_id
  LEFT JOIN quality_metric q ON q.scan_id = latest.scan_id GROUP BY r.name)""",
    )
    + f"""SELECT name, CAST(sloc AS BIGINT) AS total_sloc, CAST(n AS BIGINT) AS total_vulnerabilities,
       CAST(h AS BIGINT) AS high_vulnerabilities, CAST(m AS BIGINT) AS medium_vulnerabilities,
       CAST(l AS BIGINT) AS low_vulnerabilities,
       CASE WHEN sloc > 0 THEN printf('%.2f', {_half_up("n / sloc * 1000")}) ELSE 'N/A' END AS per_1000_lines FROM j""",
    "top_descriptions": _with(SCAN, FINDINGS, _ANY)
    + """SELECT description, count(*) AS finding_count FROM findings JOIN latest USING (scan_id)
GROUP BY description ORDER BY finding_count DESC, description LIMIT 5""",
    "top_repositories": _with(REPOSITORY, SCAN, FINDINGS, _ANY)
    + """SELECT r.id AS repository_id, name, count(*) AS finding_count
FROM findings JOIN latest USING (scan_id) JOIN repository r ON r.id = repository_id
GROUP BY r.id, name ORDER BY finding_count DESC, r.id LIMIT 5""",
    "recent_scans": _with(SCAN)
    + """SELECT id, repository_id, scan_type, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM scan ORDER BY scan.created_at DESC, id DESC LIMIT 5""",
    "scans_newest_first": _with(SCAN)
    + """SELECT id, repository_id, scan_type, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM scan""",
}



INVENTORY = r"""inventory AS (
  SELECT DISTINCT l_suppkey AS repo,
         CASE l_returnflag WHEN 'A' THEN 'src/' WHEN 'N' THEN 'tests/' ELSE 'pkg/build/' END || 'p' || (l_partkey % 97) || '/' ||
         CASE l_linenumber WHEN 1 THEN 'f.py' WHEN 2 THEN 'Dockerfile' WHEN 3 THEN 'values.yaml' WHEN 4 THEN 'LICENSE'
              WHEN 5 THEN 'f.rs' WHEN 6 THEN 'Gemfile' ELSE 'notes.md' END AS path
  FROM lineitem)"""
PAGE_PATHS = r"""page_paths AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path
  FROM pages)"""
_LISTED = "id, scan_id, file_path, line_number, description, severity"
_BASE = "regexp_extract(path, '[^/]*$')"
_SOURCE = f"{_BASE} <> 'LICENSE' AND path NOT LIKE '%.md' AND NOT contains(path, 'build/')"
_CONFIG = f"{_BASE} IN ('Dockerfile', 'Gemfile') OR path LIKE '%.yaml'"
_GROUP = "CASE WHEN line_number >= 6 THEN 'General' ELSE file_path END"
_LAST = """SELECT repository_id, id AS scan_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS rn
  FROM scan WHERE scan_type = '{kind}') WHERE rn = 1"""

LISTING = {
    "findings_filtered": _with(FINDINGS)
    + f"SELECT {_LISTED} FROM findings WHERE severity = 'HIGH' AND description LIKE 'semgrep:%'",
    "findings_of_repository": _with(SCAN, FINDINGS)
    + f"SELECT {_LISTED} FROM findings WHERE scan_id IN (SELECT id FROM scan WHERE repository_id = 7)",
    "findings_with_description": _with(FINDINGS)
    + f"SELECT {_LISTED} FROM findings WHERE description = 'Gitleaks: red widget'",
    "findings_with_keyword": _with(FINDINGS)
    + f"SELECT {_LISTED} FROM findings WHERE contains(lower(description), 'widget')",
    "severity_mapping": f"""SELECT {RAW_LEVEL} AS raw, {_SEVERITY} AS severity, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "path_languages": _with(INVENTORY, PAGE_PATHS)
    + f"""SELECT repo, path, CASE WHEN {_BASE} = 'f.py' THEN 'Python' WHEN {_BASE} = 'f.rs' THEN 'Rust'
       WHEN {_BASE} = 'Gemfile' THEN 'Ruby' WHEN path LIKE '%.html' THEN 'HTML' END AS language
FROM (SELECT CAST(repo AS VARCHAR) AS repo, path FROM inventory UNION ALL SELECT repo, path FROM page_paths)""",
    "finding_descriptions": _with(FINDINGS)
    + """SELECT id, CASE WHEN tool = 'gitleaks' THEN description ELSE split_part(description, ' (http', 1) END AS description_text,
       CASE WHEN tool = 'gitleaks' THEN NULL ELSE rtrim(split_part(description, ' (', 2), ')') END AS description_url,
       CASE tool WHEN 'semgrep' THEN rtrim(split_part(description, '/r/', 2), ')')
            WHEN 'bandit' THEN replace(split_part(description, '/plugins/', 2), '.html)', '') END AS rule_id
FROM findings""",
    "confident_findings": _with(FINDINGS) + "SELECT id, confidence_score FROM findings WHERE confidence_score >= 0.7",
    "patch_candidates": _with(FINDINGS) + "SELECT id, confidence_score FROM findings WHERE confidence_score > 0.7",
    "source_files": _with(INVENTORY)
    + f"SELECT repo, path FROM inventory WHERE {_SOURCE} AND path NOT LIKE 'tests/%'",
    "source_files_with_tests": _with(INVENTORY) + f"SELECT repo, path FROM inventory WHERE {_SOURCE}",
    "config_files": _with(INVENTORY) + f"SELECT repo, path FROM inventory WHERE {_CONFIG}",
    "config_inputs": _with(INVENTORY)
    + f"SELECT repo, path, '# ' || path AS content FROM inventory WHERE ({_CONFIG}) AND NOT regexp_matches(path, '/p[0-9]?[0-4]/')",
    "repository_urls": _with(REPOSITORY)
    + """SELECT id, u.url, repository.url AS clone_url, u.branch,
       split_part(replace(repository.url, '.git', ''), '/', 5) AS name,
       CASE WHEN u.url LIKE '%.git' THEN u.url ELSE u.url || '.git' END AS push_url
FROM repository, LATERAL (SELECT repository.url AS url, NULL AS branch
  UNION ALL SELECT replace(repository.url, '.git', '/tree/dev/x'), 'dev/x'
  UNION ALL SELECT replace(repository.url, '.git', ''), NULL) u""",
    "log_verdicts": """SELECT doc_id, NOT (contains(lower(text), 'failed') OR contains(lower(text), 'error')) AS tests_passed
FROM documents""",
    "relative_paths": f"""SELECT {_LINE_ID} AS id, CASE l_linestatus WHEN 'O' THEN replace({_LINE_PATH}, 'src/', '')
       ELSE {_LINE_PATH} END AS file_path FROM lineitem""",
    "findings_by_severity_order": _with(FINDINGS)
    + """SELECT id, scan_id, severity, CAST(list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'], severity) - 1
       AS INTEGER) AS severity_rank FROM findings""",
    "quality_rows_sorted": _with(METRIC) + "SELECT id, scan_id, file_path, sloc FROM quality_metric",
    "last_quality_scans": _with(SCAN) + _LAST.format(kind="quality"),
    "last_deep_scans": _with(SCAN) + _LAST.format(kind="deep"),
    "scan_file_groups": _with(FINDINGS)
    + f"""SELECT scan_id, {_GROUP} AS file_group, count(*) AS file_findings,
       CAST(sum(count(*)) OVER (PARTITION BY scan_id) AS BIGINT) AS scan_findings FROM findings GROUP BY 1, 2""",
    "scan_listing": _with(FINDINGS)
    + f"""SELECT id, scan_id, {_GROUP} AS file_group, count(*) OVER (PARTITION BY scan_id, {_GROUP}) AS file_findings,
       count(*) OVER (PARTITION BY scan_id) AS scan_findings FROM findings""",
    "tool_totals": _with(FINDINGS) + "SELECT scan_id, tool, count(*) AS finding_count FROM findings GROUP BY 1, 2",
    "finding_gate": _with(FINDINGS)
    + """SELECT count(*) AS finding_count, count(*) FILTER (severity = 'HIGH') AS severe_count, count(*) = 0 AS passed
FROM findings""",
    "language_ranking": _with(
        INVENTORY,
        """c AS (SELECT repo, CASE regexp_extract(path, '[^/]*$') WHEN 'f.py' THEN 'Python' WHEN 'f.rs' THEN 'Rust'
       WHEN 'Gemfile' THEN 'Ruby' END AS language, count(*) AS n FROM inventory GROUP BY 1, 2 HAVING language IS NOT NULL)""",
    )
    + """SELECT repo, string_agg(language, ',' ORDER BY n DESC, language) AS languages,
       first(language ORDER BY n DESC, language) AS primary_language FROM c GROUP BY repo""",
    "work_estimate": _with(
        INVENTORY,
        f"""w AS (SELECT repo, count(*) FILTER (NOT contains(path, 'build/') AND path NOT LIKE 'tests/%') AS rule_files,
       count(*) FILTER ({_SOURCE} AND path NOT LIKE 'tests/%') AS source_files, count(*) AS secret_files,
       count(*) FILTER ({_CONFIG}) AS config_files FROM inventory GROUP BY repo)""",
    )
    + """SELECT repo, rule_files, source_files, secret_files, config_files, source_files AS quality_files,
       rule_files + 2 * source_files + secret_files + config_files + 2 AS total_progress FROM w""",
    "page_work_estimate": _with(PAGE_PATHS)
    + """SELECT repo, count(*) AS rule_files, count(*) AS source_files, count(*) AS secret_files, CAST(0 AS BIGINT) AS config_files,
       count(*) AS quality_files, 4 * count(*) + 2 AS total_progress FROM page_paths GROUP BY repo""",
    "files_after_exclusions": _with(REPOSITORY, INVENTORY)
    + """SELECT repo, path FROM inventory LEFT JOIN repository ON repo = id
WHERE path NOT LIKE '%.md' AND NOT coalesce(sast_exclusions = 'src' AND path LIKE 'src/%', false)
  AND NOT coalesce(sast_exclusions LIKE '*.rs%' AND (path LIKE '%.rs' OR path LIKE '%/p1%'), false)""",
}



def _reported(description: str, severity: str = RAW_LEVEL, snippet: str = "p_type", where: str = "l_linenumber < 7") -> str:
    return f"""SELECT 'reports/' || {_LINE_ID} AS report_path, {_LINE_PATH} AS file_path, l_linenumber AS line_number,
       {snippet} AS code_snippet, {description} AS description, {severity} AS severity
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where}"""


def _when_open(otherwise: str) -> str:
    return f"CASE WHEN l_linestatus = 'O' THEN {RAW_LEVEL} ELSE '{otherwise}' END"


_QUALITY_REPORT = f"""r AS (
  SELECT l_orderkey AS scan_id, CASE WHEN l_suppkey % 2 = 0 THEN 'Python' ELSE 'JavaScript' END AS scanner, l_linenumber AS n,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN 'mystery'
      ELSE ['javascript', 'ruby', 'rust', 'go', 'coverage', 'lint', 'cohesion'][l_linenumber] END AS tool,
    CASE WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN ' ' ELSE 'src/' || {_LINE_ID} END AS path,
    l_returnflag = 'R' AND NOT (l_linenumber = 6 AND l_partkey % 9 = 0) AS cut, *
  FROM lineitem)"""


INGEST = {
    "semgrep_findings": _reported("'semgrep: ' || p_name || ' (https://semgrep.dev/r/' || p_brand || ')'"),
    "bandit_findings": _reported(
        "'bandit: ' || p_name || ' (https://bandit.readthedocs.io/en/latest/plugins/' || p_brand || '.html)'"
    ),
    "brakeman_findings": _reported("'brakeman: ' || p_brand || ' - ' || p_name"),
    "njsscan_findings": _reported("'njsscan: ' || p_name", _when_open("UNKNOWN")),
    "gosec_findings": _reported("'gosec: ' || p_name"),
    "cppcheck_findings": _reported("'cppcheck: ' || p_name", f"upper({RAW_LEVEL})", "''"),
    "gitleaks_findings": _reported("'Gitleaks: ' || p_name", _when_open("HIGH")),
    "model_findings": _reported(
        "p_name", _when_open("UNKNOWN"), where="l_returnflag <> 'R' AND l_discount * 10 >= 0.7"
    ).replace("\nFROM", ", l_discount * 10 AS confidence_score\nFROM"),
    "misconfiguration_findings": f"""SELECT 'reports/' || {_LINE_ID} AS report_path, 'reports/' || {_LINE_ID} AS file_path,
       l_linenumber AS line_number, CAST(NULL AS VARCHAR) AS code_snippet, p_name AS description,
       CAST(NULL AS VARCHAR) AS severity FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "file_inventory": "SELECT source AS repo, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source",
    "report_rejects": """SELECT CASE l_suppkey % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'bandit' ELSE 'gitleaks' END AS tool,
       'undecodable' AS reject_reason, count(*) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY 1""",
    "fenced_answers": """SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN trim(text) LIKE '{%' THEN trim(text) ELSE '{}' END
       ELSE '{"turn":' || turn || ',"role":"' || role || '"}' END AS json FROM conversations""",
    "reported_advisories": """SELECT 'ADV-' || p_partkey AS advisory_id, p_brand AS package, CAST(p_size AS VARCHAR) AS version,
       CASE WHEN p_size > 10 THEN p_name ELSE 'No summary available.' END AS summary,
       'No details available.' AS details FROM part WHERE p_type <> 'SMALL'""",
    "javascript_quality": f"""SELECT {_LINE_ID} AS id, l_extendedprice AS maintainability_index,
       CASE WHEN l_returnflag <> 'A' THEN l_linenumber ELSE 0 END AS cyclomatic_complexity,
       CAST(l_quantity AS INTEGER) AS sloc FROM lineitem""",
    "ruby_quality": f"""SELECT {_LINE_ID} AS id, CASE l_returnflag WHEN 'A' THEN 100.0::DOUBLE ELSE 0 END AS maintainability_index,
       0.0::DOUBLE + l_quantity + l_tax AS cyclomatic_complexity, l_linenumber AS sloc FROM lineitem""",
    "rust_quality": f"""SELECT {_LINE_ID} AS id, l_extendedprice AS maintainability_index, l_quantity AS cyclomatic_complexity,
       l_linenumber AS sloc, CAST(l_suppkey AS INTEGER) AS lloc,
       CASE WHEN l_returnflag <> 'A' THEN l_linenumber ELSE 0 END AS comments FROM lineitem""",
    "text_quality": f"""SELECT {_LINE_ID} AS id, l_linenumber + l_suppkey AS go_complexity,
       {_half_up("l_tax * 100", 6)} AS coverage, l_linenumber + l_suppkey AS duplicated_lines,
       CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber END AS linter_issues,
       l_linenumber / 2 AS coupling, (l_linenumber + 1) / 2 AS cohesion FROM lineitem""",
    "ingested_quality_metrics": _with(_QUALITY_REPORT)
    + f""", files AS (
  SELECT scan_id, path, max(CASE WHEN cut THEN 0 WHEN n = 1 THEN l_extendedprice WHEN n = 3 THEN l_tax
           WHEN n = 2 AND l_returnflag = 'A' THEN 100 ELSE 0 END) AS maintainability_index,
    max(CASE WHEN n = 4 THEN CASE WHEN NOT cut THEN n + l_suppkey ELSE n END WHEN cut THEN 0 WHEN n = 1 THEN n
           WHEN n = 2 THEN CAST(floor(l_quantity + n) AS INTEGER) ELSE CAST(floor(l_quantity) AS INTEGER) END)::INTEGER AS cyclomatic_complexity,
    max(CASE WHEN cut THEN 0 WHEN n = 1 THEN CAST(l_quantity AS INTEGER) WHEN n = 2 THEN l_suppkey WHEN n = 3 THEN n ELSE 0 END)::INTEGER AS sloc,
    max(CASE WHEN n = 3 AND NOT cut THEN l_suppkey ELSE 0 END)::INTEGER AS lloc, max(CASE WHEN n = 3 AND NOT cut THEN 2 ELSE 0 END)::INTEGER AS comments,
    max(CASE WHEN l_linestatus = 'O' THEN l_partkey % 5 ELSE 0 END)::INTEGER AS code_churn
  FROM r WHERE n <= 4 AND path <> ' ' GROUP BY scan_id, path),
ran AS (SELECT scan_id, count(DISTINCT scanner) AS scanners FROM r WHERE tool <> 'mystery' GROUP BY scan_id),
project AS (
  SELECT scan_id, coalesce(sum(CASE WHEN n = 5 THEN l_tax * 100 END), 0) AS code_coverage,
    coalesce(sum(CASE WHEN n = 7 THEN l_suppkey END), 0) AS coupling, coalesce(sum(CASE WHEN n = 7 THEN n END), 0) AS cohesion,
    coalesce(sum(CASE WHEN n = 6 THEN l_partkey % 9 END), 0) AS linter_issues
  FROM r WHERE NOT cut AND tool <> 'mystery' GROUP BY scan_id)
SELECT md5(f.scan_id || '|' || path) AS id, f.scan_id, path AS file_path, cyclomatic_complexity, code_churn, sloc, lloc, comments,
  0 AS tests_passing, 0 AS duplicated_lines, coalesce(linter_issues, 0)::INTEGER AS linter_issues,
  {_half_up("maintainability_index", 4)} AS maintainability_index, {_half_up("coalesce(code_coverage, 0) / scanners", 4)} AS code_coverage,
  {_half_up("coalesce(coupling, 0) / scanners", 4)} AS coupling, {_half_up("coalesce(cohesion, 0) / scanners", 4)} AS cohesion,
  {_half_up("cyclomatic_complexity * code_churn", 4)} AS bug_risk_score
FROM files f JOIN ran USING (scan_id) LEFT JOIN project p USING (scan_id)""",
    "quality_report_rejects": _with(_QUALITY_REPORT)
    + """SELECT tool, scanner, CASE WHEN tool = 'mystery' THEN 'unknown tool' WHEN path = ' ' THEN 'no path' ELSE 'undecodable' END AS reject_reason,
  count(*) AS n FROM r WHERE tool = 'mystery' OR path = ' ' OR (cut AND l_linenumber <> 4) GROUP BY ALL""",
    "ref_listings": """SELECT o_orderkey AS id, replace(lower(substr(o_orderpriority, 3)), ' ', '-') AS primary_branch,
       'feature/' || replace(lower(substr(o_orderpriority, 3)), ' ', '-') AS branch,
       md5(CAST(o_orderkey AS VARCHAR)) AS latest_hash FROM orders""",
}



CORPUS_FINDINGS = rf"""corpus_findings AS (
  SELECT {_LINE_ID} AS id, l_orderkey AS scan_id,
         'src' || (l_orderkey % 20) AS repo,
         CASE WHEN l_linenumber <> 7 THEN 'f/' || (l_partkey // 20) END AS file_path,
         CASE WHEN l_linenumber = 6 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS line_number,
         CASE WHEN l_returnflag = 'A' THEN 'requires login' ELSE 'x' END AS code_snippet,
         CASE l_suppkey % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'bandit' ELSE 'gitleaks' END || ': ' || {RAW_LEVEL} AS description
  FROM lineitem)"""
FILES = r"""files AS (
  SELECT source AS repo, source || '/' || doc_id AS path, text AS content, lang AS language,
         length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS n_lines
  FROM documents)"""
CHECKOUT = r"""checkout AS (
  SELECT source AS repo, 'f/' || (doc_id // 20) AS path, text AS content,
         length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS n_lines
  FROM documents)"""
_CHECKED = """checked AS (SELECT c.id, c.repo, c.file_path, c.line_number,
       CASE WHEN c.file_path IS NOT NULL AND f.path IS NULL THEN 'file not found'
            WHEN c.line_number <> 0 AND c.line_number > f.n_lines THEN 'line out of bounds' END AS reject_reason
  FROM corpus_findings c LEFT JOIN checkout f ON f.repo = c.repo AND f.path = c.file_path)"""
DEPENDENCY = r"""dependency AS (
  SELECT DISTINCT l_orderkey AS scan_id, p_brand AS package,
         CASE WHEN p_size < 50 THEN CAST(p_size AS VARCHAR) END AS version
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
MATCHED = r"""matched AS (
  SELECT scan_id, package, version, 'ADV-' || p_partkey AS advisory_id, p_name AS summary
  FROM dependency JOIN part ON package = p_brand AND (version IS NULL OR version = CAST(p_size AS VARCHAR)))"""
_TOOLS = "CASE l_suppkey % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'bandit' ELSE 'gitleaks' END"

VALIDATION = {
    "source_checks": _with(CORPUS_FINDINGS, CHECKOUT, _CHECKED) + "SELECT * FROM checked",
    "source_check_counts": _with(CORPUS_FINDINGS, CHECKOUT, _CHECKED)
    + "SELECT reject_reason, count(*) AS n FROM checked GROUP BY reject_reason",
    "filled_snippets": _with(CORPUS_FINDINGS, CHECKOUT)
    + r"""SELECT id, corpus_findings.repo, file_path, line_number, CASE WHEN code_snippet = 'requires login' AND f.path IS NOT NULL
       THEN array_to_string(string_split(content, chr(10))[greatest(line_number - 3, 1):line_number + 3], chr(10)) ||
            CASE WHEN line_number + 3 < len(string_split(content, chr(10)))
                  AND len(string_split(content, chr(10))[greatest(line_number - 3, 1):line_number + 3]) > 0 THEN chr(10) ELSE '' END
       ELSE code_snippet END AS code_snippet
FROM corpus_findings LEFT JOIN checkout f ON f.repo = corpus_findings.repo AND f.path = file_path""",
    "confirmed_documents": """SELECT doc_id, source, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
    "advisory_matches": _with(DEPENDENCY, MATCHED)
    + "SELECT scan_id, package, version, advisory_id, summary FROM matched",
    "advisory_findings": _with(DEPENDENCY, MATCHED)
    + "SELECT DISTINCT scan_id, summary AS description, 'UNKNOWN' AS severity, advisory_id AS cve_id FROM matched",
    "linked_cves": _with(
        FINDINGS,
        """one AS (SELECT p_brand || '/' || p_size AS package,
       min('ADV-' || p_brand || CASE WHEN p_partkey % 7 = 0 THEN '-2' ELSE '-1' END) AS only_one FROM part
  GROUP BY 1 HAVING count(DISTINCT p_partkey % 7 = 0) = 1)""",
    )
    + "SELECT id, package, coalesce(cve_id, only_one) AS cve_id FROM findings LEFT JOIN one USING (package)",
    "unreported_findings": _with(
        FINDINGS,
        """f AS (SELECT scan_id, CASE WHEN line_number <> 7 THEN file_path END AS file_path, line_number,
       tool AS description, severity, severity IN ('CRITICAL', 'HIGH') AS known FROM findings)""",
    )
    + """SELECT scan_id, file_path, line_number, description, severity FROM f WHERE NOT known AND NOT EXISTS (
  SELECT 1 FROM f k WHERE k.known AND k.scan_id = f.scan_id AND k.file_path IS NOT DISTINCT FROM f.file_path
    AND k.line_number = f.line_number AND k.description = f.description)""",
    "deep_scan_findings": _with(FINDINGS, DEPENDENCY, MATCHED)
    + """SELECT 'rules' AS tool, severity, count(*) AS n FROM findings GROUP BY 1, 2 UNION ALL
SELECT 'advisory', 'UNKNOWN', count(*) FROM (SELECT DISTINCT scan_id, summary, advisory_id FROM matched)""",
    "ingested_findings": f"""SELECT md5(concat_ws('|', l_orderkey, {_TOOLS}, 'reports/' || {_LINE_ID}, 0)) AS id, l_orderkey AS scan_id,
       {_LINE_PATH} AS file_path, l_linenumber AS line_number, p_type AS code_snippet,
       CASE l_suppkey % 3 WHEN 0 THEN 'semgrep: ' || p_name || ' (https://semgrep.dev/r/' || p_brand || ')'
            WHEN 1 THEN 'bandit: ' || p_name || ' (https://bandit.readthedocs.io/en/latest/plugins/' || p_brand || '.html)'
            ELSE 'Gitleaks: ' || p_name END AS description,
       CASE WHEN l_suppkey % 3 = 2 AND l_linestatus = 'F' THEN 'HIGH' ELSE {_SEVERITY} END AS severity, 'new' AS status
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber < 7""",
    "appended_findings": f"""SELECT {_SEVERITY} AS severity, 'new' AS status, count(*) AS n, count(*) AS ids FROM lineitem GROUP BY 1""",
    "stored_tables": _with(FINDINGS, "f AS (SELECT severity FROM findings)")
    + """SELECT name, count(*) AS n, count(*) AS ids FROM (
  SELECT 'repository' AS name FROM customer UNION ALL SELECT 'scan' FROM orders UNION ALL SELECT 'findings' FROM lineitem
  UNION ALL SELECT 'evidence' FROM lineitem JOIN conversations ON conv_id = l_orderkey WHERE l_linenumber = 1
  UNION ALL SELECT 'quality_metric' FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT 'quality_interpretation' FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT 'patch' FROM f WHERE severity = 'CRITICAL'
  UNION ALL SELECT 'chat_message' FROM conversations) GROUP BY name""",
    "ingest_rejects": f"""SELECT {_TOOLS} AS tool, CASE WHEN l_linenumber = 7 THEN 'undecodable' END AS reject_reason, count(*) AS reports
FROM lineitem GROUP BY 1, 2""",
    "suppressed_findings": _with(FINDINGS)
    + """SELECT id, description, CASE WHEN code_snippet <> 'SMALL' THEN code_snippet END AS code_snippet
FROM findings WHERE length(description) % 2 = 1""",
    "exported_findings": _with(REPOSITORY, SCAN, FINDINGS, _ANY)
    + """SELECT url, f.id, f.scan_id, file_path, line_number, code_snippet, description, severity, confidence_score,
       f.status, cve_id FROM findings f JOIN latest USING (scan_id) JOIN repository r ON r.id = repository_id""",
    "nested_findings_report": _with(
        REPOSITORY,
        SCAN,
        FINDINGS,
        """e AS (SELECT f.id, string_agg(role || turn || '=' || text, chr(10) ORDER BY role || turn) AS evidence
  FROM findings f JOIN conversations ON conv_id = scan_id AND line_number = 1 GROUP BY f.id)""",
    )
    + """SELECT r.id AS repository_id, r.name, count(*) OVER (PARTITION BY r.id) AS finding_count, CAST(0 AS BIGINT) AS page,
       f.id, description, confidence_score, coalesce(evidence, '') AS evidence
FROM findings f JOIN scan s ON s.id = scan_id JOIN repository r ON r.id = repository_id LEFT JOIN e ON e.id = f.id""",
    "transcripts": """SELECT conv_id AS thread_id, CAST(0 AS BIGINT) AS segment,
       string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""",
    "model_inputs": _with(CORPUS_FINDINGS, CHECKOUT)
    + """SELECT checkout.repo, path, CAST(0 AS BIGINT) AS segment, content,
       coalesce(string_agg('- **Line ' || line_number || ':** ' || description, chr(10)
         ORDER BY line_number, description, id), '') AS existing_findings, false AS is_test
FROM checkout LEFT JOIN corpus_findings ON file_path = path AND corpus_findings.repo = checkout.repo
WHERE trim(content, E' \t\n\v\f\r') <> '' GROUP BY checkout.repo, path, content""",
}


LINES = r"""lines AS (
  SELECT path, language, line_number, pieces[line_number] AS line
  FROM (SELECT path, language, pieces, unnest(range(1, n_lines + 1)) AS line_number
        FROM (SELECT *, string_split(content, chr(10)) AS pieces FROM files)))"""
_RULES = r"""rules(rule_id, pattern, severity, description, lang) AS (VALUES
  ('hardcoded-token', 'token\s*=\s*"[0-9a-f]{40}"', 'ERROR', 'rules: Hard-coded token', NULL),
  ('private-address', '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', 'INFO', 'rules: Literal IP address', NULL),
  ('copyleft', 'GNU General Public License', 'WARNING', 'rules: Copyleft license text', NULL),
  ('noise', '(\$\$\$|%%%|###)', 'INFO', 'rules: Placeholder characters', 'en'))"""
_SECRETS = [
    ("token", r'token\s*=\s*"([0-9a-f]{40})"', "HIGH", "Access token"),
    ("email", r"([A-Za-z0-9.]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+)", "MEDIUM", "E-mail address"),
    ("private-key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", "CRITICAL", "Private key"),
]
_SECRET_UNION = " UNION ALL ".join(
    f"SELECT path, line_number, '{rule}' AS rule_id, '{severity}' AS severity, 'Gitleaks: {message}' AS description,"
    f" unnest(regexp_extract_all(line, '{pattern}', 1)) AS secret FROM lines"
    for rule, pattern, severity, message in _SECRETS
) + """ UNION ALL SELECT path, line_number, 'card-number', 'HIGH', 'Gitleaks: Payment card number',
       unnest(list_filter(regexp_extract_all(line, '[0-9]+'), lambda x: length(x) = 16)) FROM lines"""
METRICS = r"""words AS (
  SELECT path, regexp_extract_all(content, '[A-Za-z0-9_]+') AS words,
         regexp_extract_all(content, '[-+*/%=<>!&|^~?:.,;(){}\[\]]') AS signs,
         len(regexp_extract_all(content, '&&|\|\|')) AS branch_signs FROM files),
line_facts AS (
  SELECT path, count(*) AS lines, count(*) FILTER (trim(line, E' \t\r\f') = '') AS blank,
         count(*) FILTER (regexp_matches(line, '^[ \t]*(#|//)')) AS comments FROM lines GROUP BY path),
metrics AS (
  SELECT path, CAST(coalesce(lines, 0) AS INTEGER) AS lines, CAST(coalesce(blank, 0) AS INTEGER) AS blank,
         CAST(coalesce(comments, 0) AS INTEGER) AS comments,
         CAST(coalesce(lines - blank - comments, 0) AS INTEGER) AS sloc,
         CAST(1 + branch_signs + len(list_filter(words, lambda w: w IN ('if', 'elif', 'for', 'while', 'case', 'catch', 'except', 'and', 'or'))) AS INTEGER)
           AS cyclomatic_complexity,
         len(words) + len(signs) AS n, len(list_distinct(words)) + len(list_distinct(signs)) AS vocabulary,
         CASE WHEN vocabulary > 0 THEN n * log2(vocabulary) ELSE 0 END AS volume
  FROM words LEFT JOIN line_facts USING (path))"""
_INDEX = (
    "least(greatest((171 - 5.2 * ln(volume) - 0.23 * cyclomatic_complexity - 16.2 * ln(sloc)"
    " + 50 * sin(sqrt(2.46 * radians(100.0 * comments / sloc)))) * 100 / 171, 0), 100)"
)
_PROJECT = r"""project AS (
  SELECT l_suppkey % 20 AS repo, sum(CASE WHEN l_linenumber < 7 THEN l_tax * 100 ELSE 0 END) / count(*) AS code_coverage,
         sum(CASE WHEN l_linenumber < 7 THEN l_quantity ELSE 0 END) / count(*) AS coupling,
         sum(l_discount) / count(*) AS cohesion, count(*) FILTER (l_linenumber < 7) AS tests_passing,
         CAST(sum(l_linenumber) AS BIGINT) AS duplicated_lines, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS linter_issues
  FROM lineitem GROUP BY 1)"""
_SHINGLES = r"""tokens AS (
  SELECT repo, path, unnest(t) AS token, line_number, generate_subscripts(t, 1) AS k
  FROM (SELECT split_part(path, '/', 1) AS repo, path, line_number,
               regexp_extract_all(line, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]') AS t FROM lines)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_number, k) AS rn, count(*) OVER (PARTITION BY path) AS n
  FROM tokens),
shingles AS (
  SELECT *, CASE WHEN rn <= n - 69 THEN string_agg(token, ' ') OVER
           (PARTITION BY path ORDER BY rn ROWS BETWEEN CURRENT ROW AND 69 FOLLOWING) END AS shingle FROM placed),
counted AS (SELECT *, shingle IS NOT NULL AND count(*) OVER (PARTITION BY repo, shingle) > 1 AS starts FROM shingles),
covered AS (
  SELECT *, bool_or(starts) OVER (PARTITION BY path ORDER BY rn ROWS BETWEEN 69 PRECEDING AND CURRENT ROW) AS inside
  FROM counted),
doubled AS (SELECT DISTINCT repo, path, line_number FROM covered WHERE inside)"""
_DIFF = r"""added AS (
  SELECT CAST(split_part(path, '/', 2) AS BIGINT) AS commit_hash, path || '.py' AS path, line,
         CAST(5 + line_number - 1 - (line_number - 1) // 3 AS INTEGER) AS line_number
  FROM lines WHERE line_number % 3 = 1)"""

CORPUS = {
    "rule_scan": _with(FILES, LINES, _RULES)
    + """SELECT path, CAST(line_number AS INTEGER) AS line_number, line AS code_snippet, rule_id, severity, description
FROM lines JOIN rules ON regexp_matches(line, pattern) AND (lang IS NULL OR lang = language)""",
    "secret_scan": _with(FILES, LINES, f"secrets AS ({_SECRET_UNION})")
    + """SELECT path, CAST(line_number AS INTEGER) AS line_number, rule_id, severity, description,
       left(secret, 2) || '********' AS code_snippet, sha256('of the host|' || secret) AS fingerprint FROM secrets""",
    "anchored_rule_scan": _with(FILES, LINES)
    + """SELECT path, CAST(line_number AS INTEGER) AS line_number, rule_id FROM lines JOIN (VALUES
  ('opening', '^The '), ('closing', 'ing\\.$'), ('short', '^[A-Za-z]+\\.$')) r(rule_id, pattern) ON regexp_matches(line, pattern)""",
    "quoted_rule_scan": _with(FILES, LINES)
    + """SELECT path, CAST(line_number AS INTEGER) AS line_number, rule_id FROM lines JOIN (VALUES
  ('quoted', '''[0-9a-z]+''|"[0-9a-z]+"'), ('quoted-again', '= (''[0-9a-z]+''|"[0-9a-z]+")'), ('end', '(ing|ent)[.]$')) r(rule_id, pattern)
  ON regexp_matches(line, pattern)""",
    "rule_pack_scan": """WITH named AS (
  SELECT l_orderkey AS path, l_linestatus, p_name || ' ' || p_type || '/' || p_size AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
numbered AS (
  SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS line_number, max(l_linestatus) OVER (PARTITION BY path) AS language FROM named)
SELECT path, line_number::INTEGER AS line_number, line AS code_snippet, 'part-' || p_partkey AS rule_id, 'rules: ' || p_brand AS description
FROM numbered JOIN part ON line = p_name || ' ' || p_type || '/' || p_size WHERE p_partkey % 3 <> 0 OR language = 'O'""",
    "line_metrics": _with(FILES, LINES, METRICS) + "SELECT path, lines, blank, comments, sloc FROM metrics",
    "code_complexity": _with(FILES, LINES, METRICS) + "SELECT path, cyclomatic_complexity FROM metrics",
    "halstead_volume": _with(FILES, LINES, METRICS) + f"SELECT path, {_half_up('volume', 4)} AS halstead_volume FROM metrics",
    "maintainability_index": _with(FILES, LINES, METRICS)
    + f"""SELECT path, CASE WHEN volume > 0 AND sloc > 0 THEN {_half_up(_INDEX, 4)} ELSE 100 END AS maintainability_index
FROM metrics""",
    "code_churn": """SELECT user_id % 20 AS repo, user_id AS file, count(DISTINCT event_id) AS code_churn
FROM events GROUP BY 1, 2""",
    "code_churn_renamed": """WITH RECURSIVE f AS (SELECT DISTINCT user_id AS file FROM events),
chain AS (
  SELECT file AS old, file + 20 AS name FROM f
  UNION ALL SELECT old, name + 20 FROM chain JOIN f ON f.file = chain.name),
ends AS (SELECT old, max(name) AS name FROM chain GROUP BY old)
SELECT user_id % 20 AS repo, name AS file, count(DISTINCT event_id) AS code_churn
FROM events JOIN ends ON old = user_id GROUP BY 1, 2""",
    "bug_risk": _with(
        FILES,
        LINES,
        METRICS,
        """churn AS (SELECT 'src' || (user_id % 20) || '/' || user_id AS path, count(DISTINCT event_id) AS code_churn
  FROM events GROUP BY 1)""",
    )
    + """SELECT path, cyclomatic_complexity, coalesce(code_churn, 0) AS code_churn,
       CAST(cyclomatic_complexity * coalesce(code_churn, 0) AS DOUBLE) AS bug_risk_score
FROM metrics LEFT JOIN churn USING (path)""",
    "project_metrics": _with(_PROJECT)
    + f"""SELECT repo, {_half_up("code_coverage", 4)} AS code_coverage, {_half_up("coupling", 4)} AS coupling,
       {_half_up("cohesion", 4)} AS cohesion, tests_passing, duplicated_lines, linter_issues FROM project""",
    "assembled_metrics": _with(FILES, LINES, METRICS, _PROJECT)
    + f"""SELECT path, sloc, CASE WHEN language = 'en' THEN 50.0::DOUBLE ELSE {_half_up("code_coverage", 4)} END AS code_coverage,
       coalesce({_half_up("coupling", 4)}, 0) AS coupling, coalesce({_half_up("cohesion", 4)}, 0) AS cohesion,
       tests_passing, duplicated_lines, linter_issues
FROM metrics JOIN files USING (path) LEFT JOIN project ON files.repo = 'src' || project.repo""",
    "duplicated_lines_by_file": _with(FILES, LINES, _SHINGLES)
    + "SELECT repo, path, count(*) AS duplicated_lines FROM doubled GROUP BY repo, path",
    "duplicated_line_ranges": _with(FILES, LINES, _SHINGLES)
    + """, ordered AS (SELECT path, line_number, dense_rank() OVER (PARTITION BY path ORDER BY line_number) AS at FROM tokens),
islands AS (
  SELECT d.repo, d.path, d.line_number, o.at - row_number() OVER (PARTITION BY d.path ORDER BY o.at) AS island
  FROM doubled d JOIN (SELECT DISTINCT * FROM ordered) o ON o.path = d.path AND o.line_number = d.line_number)
SELECT repo, path, min(line_number)::INTEGER AS first_line, max(line_number)::INTEGER AS last_line, count(*) AS lines
FROM islands GROUP BY repo, path, island""",
    "duplicated_lines": _with(FILES, LINES, _SHINGLES)
    + "SELECT repo, count(*) AS duplicated_lines FROM doubled GROUP BY repo",
    "diff_added_lines": _with(FILES, LINES, _DIFF) + "SELECT commit_hash, path, line_number, line FROM added",
    "diff_scan": _with(FILES, LINES, _DIFF, _RULES)
    + """SELECT commit_hash, path, line_number, rule_id, severity FROM added JOIN rules
ON regexp_matches(line, pattern) AND lang IS NULL""",
}


PUSHES = r"""classified AS (
  SELECT event_id, ts, 'https://github.com/u/r' || user_id || '.git' AS url, 'u/r' || user_id AS full_name,
         CASE WHEN value < 30 THEN CASE WHEN event_id % 50 = 0 THEN repeat('0', 40) ELSE sha1(CAST(event_id AS VARCHAR)) END END AS commit_hash,
         CASE WHEN event_type <> 'purchase' THEN 'not a push' WHEN NOT value < 30 THEN 'invalid payload'
              WHEN event_id % 50 = 0 THEN 'branch deleted' ELSE 'accepted' END AS outcome FROM events),
pushes AS (SELECT * FROM classified WHERE outcome = 'accepted'),
newest AS (SELECT url, arg_max(commit_hash, (ts, event_id)) AS commit_hash, arg_max(event_id, (ts, event_id)) AS event_id
  FROM pushes GROUP BY url)"""
JOBS = r"""jobs AS (
  SELECT 'job-' || l_orderkey AS job_id, CASE WHEN max(l_returnflag) = 'R' THEN 'failed' ELSE 'started' END AS job_status
  FROM lineitem GROUP BY l_orderkey)"""
_INTAKE = _with(PUSHES) + "SELECT event_id, url, full_name, commit_hash, outcome FROM classified"
_FIRST_SEEN = (
    _with(PUSHES)
    + """SELECT DISTINCT url, full_name AS name FROM pushes
WHERE url NOT IN (SELECT 'https://github.com/u/r' || s_suppkey || '.git' FROM supplier)"""
)
_PROGRESS = (
    _with(SCAN)
    + """SELECT user_id AS scan_id, count(*) AS progress,
       CASE WHEN max(total_progress) > 0 THEN count(*) / max(total_progress) * 100 ELSE 0 END AS percent
FROM events LEFT JOIN scan ON id = user_id GROUP BY user_id"""
)
_KEPT = "NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"

FEED = {
    "push_intake": _INTAKE,
    "push_intake_stream": _INTAKE,
    "first_seen_repositories": _FIRST_SEEN,
    "first_seen_repositories_stream": _FIRST_SEEN,
    "new_commits_by_poll": _with(
        PUSHES,
        """polls AS (SELECT url, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS polled_at,
       arg_max(commit_hash, (ts, event_id)) AS commit_hash FROM pushes GROUP BY 1, 2)""",
    )
    + """SELECT url, strftime(polled_at, '%Y-%m-%d %H:%M:%S') AS polled_at, commit_hash,
       lag(commit_hash) OVER (PARTITION BY url ORDER BY polls.polled_at) AS previous_hash FROM polls""",
    "new_commits": _with(REPOSITORY, PUSHES)
    + """SELECT id, coalesce(commit_hash, last_commit_hash) AS last_commit_hash, needs_scan OR commit_hash IS NOT NULL AS needs_scan
FROM repository LEFT JOIN newest ON newest.url = 'https://github.com/u/r' || id || '.git'""",
    "commit_state_stream": _with(PUSHES) + "SELECT url, commit_hash, event_id, true AS needs_scan FROM newest",
    "commit_state_with_requests": _with(
        PUSHES,
        """views AS (SELECT event_id, ts, 'https://github.com/u/r' || user_id || '.git' AS url FROM events WHERE event_type = 'view')""",
        """requests AS (
  SELECT v.url, v.ts, list(p.commit_hash ORDER BY p.ts DESC, p.event_id DESC)[1 + (v.event_id % 5 = 0)::INT] AS commit_hash
  FROM views v JOIN pushes p ON p.url = v.url AND p.ts < v.ts GROUP BY v.event_id, v.url, v.ts)""",
    )
    + """SELECT url, commit_hash, event_id, NOT EXISTS (SELECT 1 FROM requests r JOIN pushes p ON p.event_id = n.event_id
  WHERE r.url = n.url AND r.commit_hash = n.commit_hash AND r.ts >= p.ts) AS needs_scan FROM newest n""",
    "commit_scan_requests": _with(REPOSITORY)
    + """SELECT id AS repository_id, 'commit' AS scan_type, 'queued' AS status, last_commit_hash AS triggering_commit_hash
FROM repository WHERE needs_scan""",
    "commit_requests_taken": _with(REPOSITORY) + "SELECT id, needs_scan AND id % 2 <> 0 AS needs_scan FROM repository",
    "new_scan_ids": _with(REPOSITORY)
    + "SELECT count(*) AS requests, count(*) AS ids, true AS above_stored FROM repository WHERE needs_scan",
    "due_scans": _with(
        REPOSITORY,
        SCAN,
        "deep AS (SELECT repository_id, id AS scan_id, created_at FROM scan WHERE scan_type = 'deep'"
        " QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) = 1)",
    )
    + """SELECT id AS repository_id, url, scan_id AS last_scan_id FROM repository LEFT JOIN deep ON repository_id = id
WHERE periodic_scan_enabled AND (deep.created_at IS NULL
  OR epoch(TIMESTAMP '2000-01-01') - epoch(deep.created_at) > periodic_scan_interval)""",
    "reconciled_scans": _with(SCAN, JOBS)
    + """SELECT id, job_id, CASE WHEN status = 'running' AND (job_status IS NULL OR job_status = 'failed') THEN 'failed'
       ELSE status END AS status FROM scan LEFT JOIN jobs USING (job_id)""",
    "scan_overview": _with(SCAN, JOBS)
    + """SELECT id, status, jobs.job_id, CASE WHEN total_progress > 0 THEN progress / total_progress * 100 ELSE 0 END AS percent,
       coalesce(branch, 'N/A') AS branch, coalesce(left(triggering_commit_hash, 7), 'N/A') AS commit,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM scan LEFT JOIN jobs ON jobs.job_id = scan.job_id""",
    "scan_progress": _PROGRESS,
    "scan_progress_stream": _PROGRESS,
    "scan_progress_until_done": _with(SCAN)
    + """SELECT user_id AS scan_id, CASE WHEN max(total_progress) > 0 THEN least(count(*), max(total_progress)) ELSE count(*) END AS progress,
       coalesce(max(total_progress) > 0 AND count(*) >= max(total_progress), false) AS finished
FROM events LEFT JOIN scan ON id = user_id GROUP BY user_id""",
    "ingested_findings_stream": VALIDATION["ingested_findings"],
    "ingest_rejects_stream": INGEST["report_rejects"],
    "findings_after_delete": _with(FINDINGS) + f"SELECT id, scan_id FROM findings WHERE scan_id {_KEPT}",
    "evidence_after_delete": f"""SELECT {_LINE_ID} AS finding_id, role || turn AS type
FROM lineitem JOIN conversations ON conv_id = l_orderkey WHERE l_linenumber = 1 AND l_orderkey {_KEPT}""",
    "metrics_after_delete": _with(METRIC) + f"SELECT id, scan_id FROM quality_metric WHERE scan_id {_KEPT}",
    "messages_after_reset": """SELECT conv_id AS finding_id, turn, role AS sender FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
    "upserted_messages": """SELECT conv_id AS thread_id, turn - 1 AS turn, role AS sender, text AS message
FROM conversations WHERE role = 'assistant' UNION ALL
SELECT conv_id, turn, role, text FROM conversations u WHERE role <> 'assistant' AND NOT EXISTS (
  SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1)""",
    "rechecked_findings": _with(FINDINGS)
    + """SELECT f.id, CASE WHEN e.event_id IS NULL THEN f.confidence_score WHEN e.event_type = 'error' THEN 0
       ELSE CAST(json_extract_string(props, '$.k') || 'e-2' AS DOUBLE) END AS confidence_score
FROM findings f LEFT JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e
  ON e.user_id = f.scan_id""",
}


DASHBOARD["finding_density_kept_up"] = DASHBOARD["finding_density"]
DASHBOARD["findings_by_language_kept_up"] = DASHBOARD["findings_by_language"]


def oracle_sql() -> dict[str, str]:
    return {**DASHBOARD, **LISTING, **INGEST, **VALIDATION, **CORPUS, **FEED}
