"""The registered queries once more, as DuckDB SQL over the raw test tables.

Views are named fragments; a statement pulls in those it mentions.  The SQL is
written for clarity (windows, sequential definitions), not derived from the
Spark plans, so the two sides check each other.
"""

from __future__ import annotations

import re

from ..functions import fixed
from . import views
from .catalog import FOCUSES

_SPACE = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


def _trim(expression: str) -> str:
    return f"regexp_replace({expression}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _case_by_remainder(key: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {key} % {len(values)} {cases} END)"


def _directory(key: str, own: str) -> str:
    cases = " ".join(f"WHEN {r} THEN '{name}'" for r, name in views.DIRECTORIES.items())
    return f"(CASE {key} % 20 {cases} ELSE {own} END)"


def _language(path: str) -> str:
    extension = rf"lower(regexp_extract({path}, '\.[^./]*$'))"
    cases = " ".join(
        f"WHEN {extension} IN ({', '.join(repr(e) for e in extensions)}) THEN '{name}'"
        for name, extensions in fixed.LANGUAGE_EXTENSIONS.items()
    )
    return f"(CASE {cases} ELSE '' END)"


def _segments(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda s: s <> '')"


def _any(items: str, condition: str) -> str:
    return f"(len(list_filter({items}, lambda s: {condition})) > 0)"


def _glob(pattern: str, segment: str = "s") -> str:
    low = pattern.lower()
    if low == "*":
        return "true"
    if low.startswith("*") and "*" not in low[1:]:
        return f"ends_with(lower({segment}), '{low[1:]}')"
    if low.endswith("*") and "*" not in low[:-1]:
        return f"starts_with(lower({segment}), '{low[:-1]}')"
    if low.startswith(".") and "*" not in low:
        return f"ends_with(lower({segment}), '{low}')"
    return f"lower({segment}) = '{low}'"


def _globs(patterns, segment: str = "s") -> str:
    return "(" + " OR ".join(_glob(p, segment) for p in patterns) + ")"


def _kind(path: str) -> str:
    return f"(CASE WHEN {_any(_segments(path), _globs(views.UTILITY_PATTERNS))} THEN 'Utility' ELSE 'Production' END)"


_IGNORED = ", ".join(f"'{d.lower()}'" for d in fixed.IGNORED_DIRECTORIES)


def _in_ignored(path: str) -> str:
    return _any(f"list_slice({_segments(path)}, 1, len({_segments(path)}) - 1)", f"lower(s) IN ({_IGNORED})")


def _above(value: str, scale) -> str:
    cases = " ".join(f"WHEN {value} > {bound} THEN '{name}'" for bound, name in scale[:-1])
    return f"(CASE {cases} ELSE '{scale[-1][1]}' END)"


def _below(value: str, scale, operator: str = "<") -> str:
    cases = " ".join(f"WHEN {value} {operator} {bound} THEN '{name}'" for bound, name in scale[:-1])
    return f"(CASE {cases} ELSE '{scale[-1][1]}' END)"


def _step(value: str, bounds) -> str:
    cases = " ".join(f"WHEN {value} < {bound} THEN {i}" for i, bound in enumerate(bounds))
    return f"(CASE {cases} ELSE {len(bounds)} END)"


_MI = "greatest(0.0, (171.0 - 0.23 * {cc} - 16.2 * ln(greatest(1, {sloc})::DOUBLE)) * 100.0 / 171.0)"
_W = "(3.0 * smells_high + 2.0 * smells_medium + 1.0 * smells_low)"


def _scaled(x: str, over: str) -> str:
    low, high = f"min({x}) OVER {over}", f"max({x}) OVER {over}"
    return f"(CASE WHEN {high} = {low} THEN 0.0 ELSE ({x} - {low}) / ({high} - {low}) END)"


def _scored(source: str, keys: str) -> str:
    over = f"(PARTITION BY {keys})"
    return f"""
      SELECT *, s_log + s_cc + s_smells + s_coupling + (1.0 - s_mi) AS badness FROM (
        SELECT *,
          {_scaled('ln(1.0 + sloc)', over)} AS s_log,
          {_scaled('sloc::DOUBLE', over)} AS s_sloc,
          {_scaled('cc', over)} AS s_cc,
          {_scaled(_W, over)} AS s_smells,
          {_scaled('coupling::DOUBLE', over)} AS s_coupling,
          {_scaled('mi', over)} AS s_mi
        FROM {source})"""


def _entropy(scored: str, keys: str) -> str:
    """The direct form: sum of -p log2 p, normalised, times mean badness."""
    return f"""
      SELECT {keys}, count(*)::BIGINT AS total_files, sum(sloc)::BIGINT AS total_sloc,
        CASE WHEN count(*) FILTER (badness > 1e-9) <= 1 OR coalesce(sum(badness) FILTER (badness > 1e-9), 0) <= 1e-9 THEN 0.0
          ELSE greatest(0.0, sum(-(badness / t) * log2(badness / t)) FILTER (badness > 1e-9)
            / log2(count(*) FILTER (badness > 1e-9)) * avg(badness) FILTER (badness > 1e-9)) END AS entropy
      FROM (SELECT *, sum(badness) FILTER (badness > 1e-9) OVER (PARTITION BY {keys}) AS t FROM {scored})
      GROUP BY {keys}"""


_DOC_PATH = (
    f"{_directory('doc_id', repr('src'))} || '/doc_' || doc_id || {_case_by_remainder('doc_id', views.EXTENSIONS)}"
)

VIEWS: dict[str, str] = {
    "v_files": f"""
      SELECT p_partkey AS file_id,
        {_directory('p_partkey', 'lower(p_type)')} || '/' || replace(p_name, ' ', '_') || '_' || p_partkey
          || {_case_by_remainder('p_partkey', views.EXTENSIONS)} AS path
      FROM part""",
    "v_functions": """
      SELECT l_returnflag AS repo, strftime(l_shipdate, '%Y-%m') AS commit_hash, path, l_quantity AS ccn,
        l_quantity::INT AS nloc, l_suppkey AS import
      FROM lineitem JOIN v_files ON file_id = l_partkey""",
    "v_file_metrics": f"""
      SELECT *, {_MI.format(cc='cc', sloc='sloc')} AS mi, {_language('path')} AS language, {_kind('path')} AS kind FROM (
        SELECT repo, commit_hash, path, sum(nloc)::BIGINT AS sloc, avg(ccn) AS cc,
          count(*) FILTER (ccn > 20)::BIGINT AS smells_high,
          count(*) FILTER (ccn > 15 AND ccn <= 20)::BIGINT AS smells_medium,
          count(*) FILTER (ccn > 10 AND ccn <= 15)::BIGINT AS smells_low,
          count(DISTINCT import)::BIGINT AS coupling
        FROM v_functions GROUP BY repo, commit_hash, path)""",
    "v_scored": _scored("v_file_metrics", "repo, commit_hash"),
    "v_metrics": _entropy("v_scored", "repo, commit_hash"),
    "v_diffusion": """
      SELECT *, CASE WHEN badness > 1e-9 THEN -(badness / t) * log2(badness / t) ELSE 0.0 END AS diffusion
      FROM (SELECT *, sum(badness) FILTER (badness > 1e-9) OVER (PARTITION BY repo, commit_hash) AS t FROM v_scored)""",
    "v_commits": """
      SELECT repo, commit_hash, commit_hash || '-01' AS ts, number AS commit_seq, number % 12 = 0 AS tagged,
        CASE WHEN previous IS NULL THEN [] WHEN number % 6 = 0 THEN [previous, before] ELSE [previous] END AS parents
      FROM (SELECT repo, commit_hash, row_number() OVER w AS number, lag(commit_hash, 1) OVER w AS previous,
              lag(commit_hash, 2) OVER w AS before
            FROM (SELECT DISTINCT l_returnflag AS repo, strftime(l_shipdate, '%Y-%m') AS commit_hash FROM lineitem)
            WINDOW w AS (PARTITION BY repo ORDER BY commit_hash))""",
    "v_history": "SELECT *, commit_hash || '-01' AS ts FROM v_metrics",
    "v_deltas": """
      SELECT *, coalesce(entropy - prev, 0.0) AS delta,
        CASE WHEN prev IS NULL OR prev = 0 THEN 0.0 ELSE (entropy - prev) / prev END AS relative_delta,
        coalesce(total_sloc - lag(total_sloc) OVER w, 0) AS sloc_delta,
        coalesce(total_files - lag(total_files) OVER w, 0) AS files_delta,
        CASE WHEN commit_seq > 1 THEN entropy - prev END AS step
      FROM (SELECT *, lag(entropy) OVER w AS prev, row_number() OVER w AS commit_seq,
              count(*) OVER (PARTITION BY repo) AS n
            FROM v_history WINDOW w AS (PARTITION BY repo ORDER BY ts, commit_hash))
      WINDOW w AS (PARTITION BY repo ORDER BY ts, commit_hash)""",
    "v_events": """
      SELECT *, CASE WHEN delta >= greatest(0.02, m + 1.5 * s) THEN 'troubled'
                     WHEN delta <= least(-0.02, m - 1.5 * s) THEN 'heroic' END AS event
      FROM (SELECT *, avg(step) OVER (PARTITION BY repo) AS m, stddev_pop(step) OVER (PARTITION BY repo) AS s FROM v_deltas)
      WHERE commit_seq > 1""",
    # the state of every history as of every commit; the last row of a repository is its whole history
    "v_as_of": """
      SELECT *,
        coalesce(mean, 0.0) AS trend,
        coalesce(k >= 3 AND steepest > mean + 1.5 * deviation AND steepest > 0.05, false) AS heat_spike,
        coalesce(k >= 5 AND least(e0, e1, e2) > e3 + 0.05 AND e2 - e3 > 0.05 AND abs(e0 - e2) < e2 - e3, false) AS heat_wave,
        coalesce(k >= 4 AND e0 < e1 AND e1 < e2 AND e2 < e3, false) AS cold_front
      FROM (SELECT *, commit_seq AS k, entropy AS e0, lag(entropy, 1) OVER w AS e1, lag(entropy, 2) OVER w AS e2,
              lag(entropy, 3) OVER w AS e3, lag(entropy, 4) OVER w AS e4,
              avg(step) OVER w AS mean, stddev_pop(step) OVER w AS deviation, max(step) OVER w AS steepest
            FROM v_deltas WINDOW w AS (PARTITION BY repo ORDER BY ts, commit_hash))""",
    "v_whole": "SELECT *, n AS commit_count FROM v_as_of WHERE commit_seq = n",
    "v_base": f"SELECT repo, path, badness FROM v_scored WHERE commit_hash = '{views.BASELINE}'",
    "v_cur": f"SELECT repo, path, badness FROM v_scored WHERE commit_hash = '{views.CURRENT}'",
    "v_pairs": """
      SELECT repo, path, b.badness AS baseline_badness, c.badness AS current_badness, c.badness - b.badness AS delta,
        CASE WHEN b.badness IS NULL THEN 'new' WHEN c.badness IS NULL THEN 'removed'
             WHEN c.badness > b.badness + 1e-9 THEN 'worsened' WHEN c.badness < b.badness - 1e-9 THEN 'improved'
             ELSE 'same' END AS status
      FROM v_base b FULL JOIN v_cur c USING (repo, path)""",
    "v_sum_base": f"""
      SELECT repo, arg_max(entropy, ts) AS entropy, arg_max(total_files, ts) AS files, arg_max(total_sloc, ts) AS sloc,
        count(*) AS commits FROM v_history WHERE commit_hash <= '{views.BASELINE}' GROUP BY repo""",
    "v_sum_cur": f"""
      SELECT repo, arg_max(entropy, ts) AS entropy, arg_max(total_files, ts) AS files, arg_max(total_sloc, ts) AS sloc,
        count(*) AS commits FROM v_history WHERE commit_hash <= '{views.CURRENT}' GROUP BY repo""",
    "v_source": f"""
      SELECT doc_id, 'repo_' || lang AS repo, source AS commit_hash, {_DOC_PATH} AS path, {_language(_DOC_PATH)} AS language,
        text FROM documents""",
    "v_lines": """
      SELECT repo, commit_hash, path, language, n, CASE (doc_id * 7 + n) % 11
          WHEN 0 THEN '/* ' || line WHEN 1 THEN '  // ' || line WHEN 6 THEN '  // ' || line WHEN 2 THEN line || ' */'
          WHEN 3 THEN CASE
            WHEN language = 'CSharp' THEN CASE n % 5
              WHEN 0 THEN 'using ' || replace(line, ' ', '.') || ';' WHEN 1 THEN 'using var x = ' || line || ';'
              WHEN 2 THEN '  using static ' || replace(line, ' ', '.') || ' ; ' WHEN 3 THEN 'using A =' || line || ';'
              ELSE 'using (x ' || line || ');' END
            WHEN language IN ('C', 'Cpp') THEN chr(9) || '#include <' || replace(line, ' ', '.') || '>'
            WHEN language = 'Rust' THEN 'use ' || replace(line, ' ', '.') || ';'
            WHEN language IN ('TypeScript', 'JavaScript') AND n % 5 = 0
              THEN 'const x = require(''' || replace(line, ' ', '.') || ''')'
            ELSE 'import ' || line || ';' END
          WHEN 4 THEN '# ' || line WHEN 5 THEN '  ' WHEN 8 THEN '/* ' || line || ' */' ELSE line || chr(13) END AS raw
      FROM (SELECT *, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS n FROM v_source)""",
    "v_trimmed": f"SELECT *, {_trim('raw')} AS line FROM v_lines",
    "v_marked": """
      SELECT *, language IN ('C', 'Cpp', 'Java', 'CSharp', 'TypeScript', 'JavaScript', 'Rust') AS c_style,
        coalesce(last_value(CASE WHEN starts_with(line, '/*') AND NOT contains(line, '*/') THEN true
                                 WHEN contains(line, '*/') THEN false END IGNORE NULLS)
          OVER (PARTITION BY repo, commit_hash, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
          AS in_block
      FROM v_trimmed""",
    "v_sloc": """
      SELECT repo, commit_hash, path, language, count(*) FILTER (line <> '' AND CASE
          WHEN c_style THEN NOT in_block AND NOT starts_with(line, '/*') AND NOT starts_with(line, '//')
          WHEN language = 'Python' THEN NOT starts_with(line, '#') ELSE true END)::BIGINT AS sloc
      FROM v_marked GROUP BY repo, commit_hash, path, language""",
    "v_using": f"""
      SELECT *, CASE WHEN starts_with(inside, 'static ') THEN substr(inside, 8) ELSE inside END AS named
      FROM (SELECT *, {_trim("substr(line, 7, length(line) - 7)")} AS inside FROM v_trimmed)""",
    "v_coupling": """
      SELECT repo, commit_hash, path, language, count(*) FILTER (CASE
          WHEN language = 'CSharp' THEN starts_with(line, 'using ') AND ends_with(line, ';')
            AND NOT starts_with(inside, '(') AND NOT starts_with(inside, 'var ')
            AND (NOT contains(named, ' ') OR substr(named, instr(named, ' ') + 1, 1) = '=')
          WHEN language = 'Java' THEN starts_with(line, 'import ') AND ends_with(line, ';')
          WHEN language IN ('TypeScript', 'JavaScript') THEN starts_with(line, 'import ')
            OR contains(line, 'require(''') OR contains(line, 'require("')
          WHEN language = 'Python' THEN starts_with(line, 'import ') OR starts_with(line, 'from ')
          WHEN language IN ('C', 'Cpp') THEN starts_with(line, '#include')
          WHEN language = 'Rust' THEN starts_with(line, 'use ') OR starts_with(line, 'extern crate ')
          ELSE false END)::BIGINT AS coupling
      FROM v_using GROUP BY repo, commit_hash, path, language""",
    "v_doc_rollup": f"""
      SELECT repo, commit_hash, {_DOC_PATH} AS path, avg(l_quantity) AS cc,
        count(*) FILTER (l_quantity > 20) AS smells_high, count(*) FILTER (l_quantity > 15 AND l_quantity <= 20) AS smells_medium,
        count(*) FILTER (l_quantity > 10 AND l_quantity <= 15) AS smells_low
      FROM lineitem JOIN (SELECT doc_id, 'repo_' || lang AS repo, source AS commit_hash FROM documents) ON doc_id = l_partkey % (SELECT max(doc_id) + 1 FROM documents)
      GROUP BY ALL""",
    "v_blob_files": f"""
      SELECT s.repo, s.commit_hash, s.path, s.language, s.sloc, coalesce(f.cc, 0.0) AS cc,
        {_MI.format(cc='coalesce(f.cc, 0.0)', sloc='s.sloc')} AS mi,
        coalesce(f.smells_high, 0)::BIGINT AS smells_high, coalesce(f.smells_medium, 0)::BIGINT AS smells_medium,
        coalesce(f.smells_low, 0)::BIGINT AS smells_low, c.coupling, {_kind('s.path')} AS kind
      FROM v_sloc s JOIN v_coupling c USING (repo, commit_hash, path) LEFT JOIN v_doc_rollup f USING (repo, commit_hash, path)
      WHERE NOT {_in_ignored('s.path')} AND NOT ends_with(lower(s.path), '.hpp')""",
    "v_blob_scored": _scored("v_blob_files", "repo, commit_hash"),
    "v_remotes": """
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'git@' || host || ':' || tail ELSE scheme || host || '/' || tail END AS remote_url
      FROM (SELECT page_id, regexp_extract(url, '^https?://') AS scheme,
              regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 1) AS host,
              regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 2) || CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '' END AS tail
            FROM pages)""",
    "v_named": """
      SELECT page_id, remote_url, CASE WHEN lower(right(cut, 4)) = '.git' THEN left(cut, length(cut) - 4) ELSE cut END AS repo
      FROM (SELECT *, CASE WHEN instr(rest, ':') > 0 AND (instr(rest, '/') = 0 OR instr(rest, ':') < instr(rest, '/'))
                THEN substr(rest, instr(rest, ':') + 1)
              WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/') + 1) ELSE rest END AS cut
            FROM (SELECT *, replace(replace(replace(remote_url, 'git@', ''), 'https://', ''), 'http://', '') AS rest FROM v_remotes))""",
    "v_branched": """
      SELECT repo, commit_hash, commit_seq AS n, ts::TIMESTAMP + CASE WHEN commit_seq % 7 = 3 THEN INTERVAL 100 DAY ELSE INTERVAL 0 DAY END AS ts,
        CASE WHEN commit_seq % 6 = 4 THEN commit_seq - 2 WHEN commit_seq % 6 = 0 THEN commit_seq - 3 WHEN commit_seq > 1 THEN commit_seq - 1 END AS p1,
        CASE WHEN commit_seq % 6 = 0 THEN commit_seq - 1 END AS p2
      FROM v_commits""",
    "v_settled": """
      WITH RECURSIVE walk AS (
        SELECT repo, 1::BIGINT AS n, [epoch_us(ts)] AS at FROM v_branched WHERE n = 1
        UNION ALL
        SELECT b.repo, b.n, list_append(w.at, greatest(epoch_us(b.ts), w.at[b.p1] + 1, coalesce(w.at[b.p2], 0) + 1))
        FROM walk w JOIN v_branched b ON b.repo = w.repo AND b.n = w.n + 1)
      SELECT b.*, w.at[w.n] AS settled, row_number() OVER (PARTITION BY b.repo ORDER BY w.at[w.n], b.commit_hash) AS seq
      FROM walk w JOIN v_branched b USING (repo, n)""",
    "v_branched_snapshots": """
      WITH RECURSIVE up AS (
        SELECT repo, n, n AS above, 0 AS steps FROM v_branched
        UNION ALL SELECT up.repo, up.n, b.p1, steps + 1 FROM up JOIN v_branched b ON b.repo = up.repo AND b.n = up.above WHERE b.p1 IS NOT NULL),
      nearest AS (
        SELECT up.repo, up.n, c.path, arg_min(c.content_hash, steps) AS content_hash, arg_min(c.is_deleted, steps) AS is_deleted
        FROM up JOIN v_changes c ON c.repo = up.repo AND c.commit_seq = up.above GROUP BY up.repo, up.n, c.path)
      SELECT b.repo, b.commit_hash, path, content_hash FROM nearest JOIN v_branched b USING (repo, n) WHERE NOT is_deleted""",
    "v_changes": """
      SELECT repo, commit_hash, path, commit_seq, 'v' || sum(nloc) % 10 AS content_hash, sum(nloc) % 7 = 0 AS is_deleted
      FROM v_functions JOIN v_commits USING (repo, commit_hash) GROUP BY repo, commit_hash, path, commit_seq""",
    "v_snapshots": """
      SELECT c.repo, c.commit_hash, i.path, i.content_hash
      FROM (SELECT *, lead(commit_seq) OVER (PARTITION BY repo, path ORDER BY commit_seq) AS until FROM v_changes) i
      JOIN v_commits c ON c.repo = i.repo AND c.commit_seq >= i.commit_seq AND c.commit_seq < coalesce(i.until, 1000000)
      WHERE NOT i.is_deleted""",
}


def _top(source: str, score: str, where: str = "true", value: str | None = None, n: int = 10) -> str:
    return f"""
      SELECT repo, commit_hash, path, {value or score}, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY {score} DESC, path) AS rank
        FROM {source} WHERE {where}) WHERE rank <= {n}"""


_BAND_PAIRS = {
    "sloc": "sloc", "cc": "cc", "smells": _W, "coupling": "coupling", "badness": "badness", "diffusion": "diffusion",
}
_MEASURES = "language, sloc, {cc} AS cc, {mi} AS mi, smells_high, smells_medium, smells_low, coupling, kind".format(
    cc=r6("cc"), mi=r6("mi")
)
_FOCUS_SQL = {
    "overall": "badness",
    "size": "s_sloc",
    "size_and_cc": "(s_sloc + s_cc) / 2",
    "maintainability": "1.0 - s_mi",
    "smelliness": "s_smells",
    "imports": "s_coupling",
    "all_five": "(s_sloc + s_cc + (1.0 - s_mi) + s_smells + s_coupling) / 5",
    "unknown_word": "badness",
}
_E6 = r6("entropy") + " AS entropy"
_D6 = r6("delta") + " AS delta"


def _signal(name: str) -> dict[str, str]:
    return {
        name: f"SELECT repo, commit_count, {name} FROM v_whole",
        f"{name}_as_of": f"SELECT repo, commit_hash, commit_seq, {name} FROM v_as_of",
    }


def _sampled(points: int) -> str:
    return f"""
      SELECT d.* FROM v_deltas d WHERE n <= {points} OR commit_seq - 1 IN (
        SELECT round_even(i * ((d.n - 1)::DOUBLE / {points - 1}), 0)::BIGINT FROM range({points}) g(i))"""


def _long_summary(view: str, name: str) -> str:
    parts = [f"SELECT repo, '{m}' AS metric, {m}::DOUBLE AS {name} FROM {view}" for m in ("entropy", "files", "sloc", "commits")]
    return "(" + " UNION ALL ".join(parts) + ")"


_PERCENTILE = f"""
  SELECT repo, commit_hash, {_E6}, history_count, {r6('percentile')} AS percentile, {r6('lo')} AS entropy_min,
    {r6('mean')} AS entropy_mean, {r6('hi')} AS entropy_max,
    {_below('percentile', fixed.POSITION_LABELS, '<=')} AS position FROM """

_BAND_UNION = " UNION ALL ".join(
    f"SELECT repo, commit_hash, '{scale}' AS scale, {_above(value, fixed.SEVERITY_SCALES[scale])} AS band FROM v_diffusion"
    for scale, value in _BAND_PAIRS.items()
)
_STEP_UNION = " UNION ALL ".join(
    f"SELECT repo, commit_hash, '{scale}' AS scale, {_step(_BAND_PAIRS[scale], bounds)} AS step FROM v_file_metrics"
    for scale, bounds in fixed.SIZE_GRADIENTS.items()
)
_VERDICT = """
  CASE WHEN entropy > baseline AND heat_wave THEN 'HeatWave'
       WHEN entropy - baseline > 0 AND heat_spike THEN 'HeatSpike'
       WHEN entropy - baseline < -0.05 AND cold_front THEN 'ColdFront'
       WHEN trend > 0.001 AND entropy - baseline > 0.01 THEN 'Warming'
       WHEN trend < -0.001 AND entropy - baseline <= 0 THEN 'Cooling' ELSE 'Stable' END"""

_RISES = """
  SELECT * FROM (
    SELECT n.repo, n.commit_hash, n.path, coalesce(o.badness, 0.0) AS old_badness, n.badness AS new_badness,
      n.badness - coalesce(o.badness, 0.0) AS delta
    FROM (SELECT * FROM v_scored JOIN v_commits USING (repo, commit_hash)) n
    LEFT JOIN (SELECT * FROM v_scored JOIN v_commits USING (repo, commit_hash)) o
      ON o.repo = n.repo AND o.path = n.path AND o.commit_seq = n.commit_seq - 1
    WHERE n.commit_seq > 1) WHERE delta > 1e-9"""

_OBSERVED = """
  SELECT c.repo, c.entropy - b.entropy AS de, (c.entropy - b.entropy) / b.entropy AS rel, c.sloc - b.sloc AS ds,
    c.files - b.files AS df, t.n, t.trend, p.*
  FROM v_sum_base b JOIN v_sum_cur c USING (repo)
  JOIN (SELECT repo, count(*) AS n, (arg_max(entropy, ts) - arg_min(entropy, ts)) / (count(*) - 1) AS trend
        FROM v_history WHERE commit_hash <= '{current}' GROUP BY repo) t USING (repo)
  LEFT JOIN (SELECT repo AS prepo, count(*) FILTER (status = 'worsened') AS hot, count(*) FILTER (status = 'improved') AS cool,
          (list(path ORDER BY delta DESC, path) FILTER (status = 'worsened'))[1] AS hot_path,
          (list(path ORDER BY delta, path) FILTER (status = 'improved'))[1] AS cool_path
        FROM v_pairs GROUP BY repo) p ON p.prepo = c.repo""".format(current=views.CURRENT)

STATEMENTS: dict[str, str] = {
    # sources and sinks
    "source_tree_scan": f"""
      SELECT repo || '/' || commit_hash || '/' || path AS path, language, sloc, 0.0 AS cc,
        {r6(_MI.format(cc='0.0', sloc='sloc'))} AS mi, 0::BIGINT AS smells_high, 0::BIGINT AS smells_medium,
        0::BIGINT AS smells_low, coupling, {_kind('path')} AS kind
      FROM v_sloc JOIN v_coupling USING (repo, commit_hash, path, language)
      WHERE NOT {_in_ignored('path')} AND NOT ends_with(lower(path), '.hpp') AND language <> ''""",
    "commit_blob_scan": f"SELECT repo, commit_hash, path, {_MEASURES} FROM v_blob_files",
    "commit_blob_totals": f"""
      SELECT repo, commit_hash, total_files, total_sloc, {_E6} FROM ({_entropy('v_blob_scored', 'repo, commit_hash')})""",
    "manifest_scan": f"""
      SELECT repo, commit_hash, path, language, sloc, 0.0 AS cc, {r6(_MI.format(cc='0.0', sloc='sloc'))} AS mi,
        0::BIGINT AS smells_high, 0::BIGINT AS smells_medium, 0::BIGINT AS smells_low, coupling, {_kind('path')} AS kind
      FROM v_sloc JOIN v_coupling USING (repo, commit_hash, path, language) WHERE NOT {_in_ignored('path')}""",
    "function_csv_source": f"""
      SELECT lower(path) AS path_key, {r6('avg(ccn)')} AS cc, count(*) FILTER (ccn > 20)::BIGINT AS smells_high,
        count(*) FILTER (ccn > 15 AND ccn <= 20)::BIGINT AS smells_medium,
        count(*) FILTER (ccn > 10 AND ccn <= 15)::BIGINT AS smells_low
      FROM v_functions WHERE nloc % 7 <> 0 AND nloc % 11 <> 0 GROUP BY lower(path)""",
    "snapshot_json_read": f"""
      SELECT repo || '/' || commit_hash || '/' || path AS document, 1::BIGINT AS commits, sloc % 5 <> 0 AS has_summary,
        CASE WHEN sloc % 5 <> 0 THEN {r6('cc')} ELSE 0.0 END AS entropy, (sloc % 5 <> 0)::BIGINT AS files,
        CASE WHEN sloc % 5 <> 0 THEN sloc ELSE 0 END AS sloc,
        CASE WHEN sloc % 7 <> 0 THEN commit_hash ELSE '' END AS first_hash,
        CASE WHEN sloc % 7 <> 0 THEN {r6('mi')} ELSE 0.0 END AS first_entropy
      FROM v_file_metrics""",
    "snapshot_json_history": f"""
      WITH e AS (SELECT *, repo || '_' || left(commit_hash, 4) AS document, left(commit_hash, 4)::INT AS y FROM v_history)
      SELECT document, 'history' AS section, row_number() OVER (PARTITION BY document ORDER BY commit_hash) - 1 AS position,
        CASE WHEN total_sloc % 3 <> 0 THEN commit_hash ELSE '' END AS name,
        CASE WHEN total_sloc % 4 <> 0 THEN commit_hash || '-01' ELSE '' END AS date,
        CASE WHEN total_sloc % 5 <> 0 THEN {r6('entropy')} ELSE 0.0 END AS entropy, total_files::BIGINT AS files, total_sloc::BIGINT AS sloc
      FROM e
      UNION ALL
      SELECT document, CASE WHEN y % 5 <> 0 THEN 'summary' ELSE 'no summary' END, count(*), '', '',
        CASE WHEN y % 5 <> 0 THEN {r6('max(entropy)')} ELSE 0.0 END, CASE WHEN y % 5 <> 0 THEN sum(total_files) ELSE 0 END::BIGINT,
        CASE WHEN y % 5 <> 0 THEN sum(total_sloc) ELSE 0 END::BIGINT FROM e GROUP BY document, y""",
    "snapshot_json_files": f"""
      SELECT repo || '/' || commit_hash || '/' || path AS document, path, language, sloc, {r6('cc')} AS cc, {r6('mi')} AS mi,
        smells_high, smells_medium, smells_low, CASE WHEN sloc % 3 <> 0 THEN coupling ELSE 0 END::DOUBLE AS coupling,
        0.0 AS badness, CASE WHEN sloc % 4 <> 0 THEN kind ELSE 'Production' END AS kind
      FROM v_file_metrics""",
    "snapshot_json_write": f"""
      SELECT repo, 'history' AS section, commit_hash AS name, ts AS date, {r6('entropy')} AS value, total_files AS files,
        total_sloc AS sloc FROM v_history
      UNION ALL
      SELECT repo, 'file', path, '', {r6('badness')}, 1::BIGINT, sloc
      FROM v_scored JOIN (SELECT repo, max(commit_hash) AS commit_hash FROM v_commits GROUP BY repo) USING (repo, commit_hash)
      UNION ALL
      SELECT repo, 'summary', count(*)::VARCHAR, '', {r6('max_by(entropy, commit_hash)')}, max_by(total_files, commit_hash),
        max_by(total_sloc, commit_hash) FROM v_history GROUP BY repo
      UNION ALL
      SELECT DISTINCT repo, 'frame', unnest(['],"latestFiles":[', ']}}']), '', 0.0, 0::BIGINT, 0::BIGINT FROM v_history""",
    "metrics_tables_write": """
      SELECT repo, commit_hash, count(*)::BIGINT AS total_files, sum(sloc)::BIGINT AS total_sloc
      FROM v_file_metrics GROUP BY repo, commit_hash""",
    "pattern_file_source": """
      SELECT repo, commit_hash, path, line AS pattern FROM v_trimmed WHERE line <> '' AND NOT starts_with(line, '#')""",
    "chart_series_sink": f"""
      WITH sampled AS ({_sampled(50)}), stats_at AS ({_sampled(20)})
      SELECT repo, commit_hash, ts AS x, 'entropy' AS series, {r6('entropy')} AS y FROM sampled
      UNION ALL SELECT repo, commit_hash, ts, 'sloc', total_sloc::DOUBLE FROM sampled
      UNION ALL SELECT repo, commit_hash, ts, 'sloc_per_file', {r6('total_sloc / total_files')} FROM sampled
      UNION ALL SELECT repo, commit_hash, any_value(ts), 'avg_cc', {r6('avg(cc)')}
        FROM stats_at JOIN v_file_metrics USING (repo, commit_hash) GROUP BY repo, commit_hash
      UNION ALL SELECT repo, commit_hash, any_value(ts), 'avg_smell', {r6(f'avg({_W})')}
        FROM stats_at JOIN v_file_metrics USING (repo, commit_hash) GROUP BY repo, commit_hash""",
    # filters, projections, classification
    "scope_ignored_dirs": f"SELECT file_id, path FROM v_files WHERE NOT {_in_ignored('path')}",
    "scope_exclude_globs": f"""
      SELECT file_id, path FROM v_files WHERE NOT {_any(_segments('path'), _globs(views.EXCLUDE_PATTERNS))}""",
    "scope_exclude_globs_by_repo": f"""
      SELECT file_id, p_brand AS repo, path
      FROM v_files JOIN (SELECT p_partkey, p_brand, regexp_extract(p_brand, '[0-9]+')::INT AS b FROM part) ON p_partkey = file_id
      WHERE NOT (
        CASE b % 3 WHEN 0 THEN {_any(_segments('path'), _glob('*.cs'))} WHEN 1 THEN {_any(_segments('path'), _glob('*.py'))}
          ELSE {_any(_segments('path'), _glob('*.md'))} END
        OR CASE b % 4 WHEN 0 THEN {_any(_segments('path'), _glob('red*'))} WHEN 1 THEN {_any(_segments('path'), _glob('tools'))}
          WHEN 2 THEN {_any(_segments('path'), _glob('.tsx'))} ELSE {_any(_segments('path'), _glob('a+b'))} END)""",
    "scope_include_globs": f"""
      SELECT file_id, path FROM (SELECT *, list_last(string_split(path, '/')) AS s FROM v_files)
      WHERE {_globs(views.INCLUDE_PATTERNS)}""",
    "classify_kind": f"SELECT file_id, path, {_kind('path')} AS kind FROM v_files",
    "filter_kind": "SELECT repo, commit_hash, path, kind, sloc FROM v_file_metrics WHERE kind = 'Utility'",
    "language_assign": f"SELECT file_id, path, {_language('path')} AS language FROM v_files",
    "recognised_only": f"""
      SELECT * FROM (SELECT file_id, path, {_language('path')} AS language FROM v_files) WHERE language <> ''""",
    "commits_checkpoint": """
      SELECT repo, commit_hash, ts, tagged AS is_tagged, len(parents) > 1 AS is_merge FROM v_commits
      WHERE tagged OR len(parents) > 1""",
    "commits_since": f"""
      SELECT repo, commit_hash, ts FROM v_commits c
      WHERE commit_seq >= (SELECT commit_seq FROM v_commits s WHERE s.repo = c.repo AND s.commit_hash = '{views.START}')""",
    "commit_prefix_filter": f"""
      SELECT repo, commit_hash, total_files, total_sloc, {_E6} FROM v_metrics WHERE starts_with(commit_hash, '1996-')""",
    # lines
    "sloc_by_file": "SELECT * FROM v_sloc",
    "coupling_by_file": "SELECT * FROM v_coupling",
    "maintainability_index": f"""
      SELECT repo, commit_hash, CASE WHEN nloc % 3 = 0 THEN upper(path) ELSE path END AS path, nloc::BIGINT AS sloc,
        ccn AS cc, {r6(_MI.format(cc='ccn', sloc='nloc'))} AS mi FROM v_functions""",
    # aggregations
    "function_rollup": f"""
      SELECT repo, commit_hash, lower(path) AS path_key, {r6('avg(ccn)')} AS cc, count(*) FILTER (ccn > 20)::BIGINT AS smells_high,
        count(*) FILTER (ccn > 15 AND ccn <= 20)::BIGINT AS smells_medium,
        count(*) FILTER (ccn > 10 AND ccn <= 15)::BIGINT AS smells_low
      FROM v_functions GROUP BY repo, commit_hash, lower(path)""",
    "commit_totals": """
      SELECT repo, commit_hash, count(*)::BIGINT AS total_files, sum(sloc)::BIGINT AS total_sloc
      FROM v_file_metrics GROUP BY repo, commit_hash""",
    "sloc_by_language": f"""
      SELECT *, {r6('total_sloc * 100.0 / sum(total_sloc) OVER (PARTITION BY repo, commit_hash)')} AS share
      FROM (SELECT repo, commit_hash, language, count(*)::BIGINT AS file_count, sum(sloc)::BIGINT AS total_sloc
            FROM v_file_metrics WHERE language <> '' GROUP BY repo, commit_hash, language)""",
    "language_listing": f"""
      SELECT path, language FROM (SELECT path, {_language('path')} AS language FROM v_files) WHERE language <> ''""",
    "detected_languages": "SELECT DISTINCT repo, language FROM v_file_metrics WHERE language <> ''",
    "commit_file_stats": f"""
      SELECT repo, commit_hash, {r6('avg(cc)')} AS avg_cc, {r6(f'avg({_W})')} AS avg_smell,
        {r6('sum(sloc)::DOUBLE / count(*)')} AS sloc_per_file FROM v_file_metrics GROUP BY repo, commit_hash""",
    "history_range": f"""
      SELECT repo, {r6('min(entropy)')} AS entropy_min, {r6('avg(entropy)')} AS entropy_mean, {r6('max(entropy)')} AS entropy_max
      FROM v_metrics GROUP BY repo""",
    "health_gauges": f"""
      SELECT repo, commit_hash, {r6('e')} AS entropy, {r6('c')} AS avg_cc, {r6('s')} AS avg_smell,
        {r6('least(100.0, e / 3.0 * 100.0)')} AS entropy_pct, {_below('least(100.0, e / 3.0 * 100.0)', fixed.GAUGE_BANDS)} AS entropy_band,
        {r6('least(100.0, c / 20.0 * 100.0)')} AS cc_pct, {_below('least(100.0, c / 20.0 * 100.0)', fixed.GAUGE_BANDS)} AS cc_band,
        {r6('least(100.0, s / 15.0 * 100.0)')} AS smells_pct, {_below('least(100.0, s / 15.0 * 100.0)', fixed.GAUGE_BANDS)} AS smells_band
      FROM (SELECT repo, commit_hash, any_value(m.entropy) AS e, avg(cc) AS c, avg({_W}) AS s
            FROM v_file_metrics JOIN v_metrics m USING (repo, commit_hash)
            JOIN (SELECT repo, max(commit_hash) AS commit_hash FROM v_commits GROUP BY repo) USING (repo, commit_hash)
            GROUP BY repo, commit_hash)""",
    "severity_bands": f"""
      SELECT repo, commit_hash, scale, band, count(*)::BIGINT AS file_count FROM ({_BAND_UNION}) GROUP BY ALL""",
    "size_gradient_bands": f"""
      SELECT repo, commit_hash, scale, step::BIGINT AS step, count(*)::BIGINT AS file_count FROM ({_STEP_UNION}) GROUP BY ALL""",
    # scoring
    "badness_by_file": f"SELECT repo, commit_hash, path, {r6('badness')} AS badness FROM v_scored",
    "entropy_by_commit": f"SELECT repo, commit_hash, total_files, total_sloc, {_E6} FROM v_metrics",
    "entropy_by_commit_kind": f"""
      WITH by_kind AS ({_scored('v_file_metrics', 'repo, commit_hash, kind')})
      SELECT repo, commit_hash, kind, total_files, total_sloc, {_E6} FROM ({_entropy('by_kind', 'repo, commit_hash, kind')})""",
    "refactor_scores": "SELECT repo, commit_hash, path, "
    + ", ".join(f"{r6(_FOCUS_SQL[name])} AS {name}" for name in FOCUSES)
    + " FROM v_scored",
    "diffusion_contributions": f"SELECT repo, commit_hash, path, {r6('diffusion')} AS diffusion FROM v_diffusion",
    "heat_rank": f"""
      SELECT repo, commit_hash, path, {r6('badness')} AS badness, {r6('badness / m')} AS heat,
        round_even(badness / m * 10, 0)::BIGINT AS bar
      FROM (SELECT *, CASE WHEN max(badness) OVER w = 0 THEN 1 ELSE max(badness) OVER w END AS m FROM v_scored
            WINDOW w AS (PARTITION BY repo, commit_hash))""",
    # history
    "commit_deltas": f"""
      SELECT repo, commit_hash, ts, total_files, total_sloc, {_E6}, commit_seq, {_D6},
        {r6('relative_delta')} AS relative_delta, sloc_delta, files_delta FROM v_deltas""",
    "troubled_commits": f"SELECT repo, commit_hash, commit_seq, {_E6}, {_D6} FROM v_events WHERE event = 'troubled'",
    "heroic_commits": f"SELECT repo, commit_hash, commit_seq, {_E6}, {_D6} FROM v_events WHERE event = 'heroic'",
    "notable_events": f"""
      SELECT repo, commit_hash, commit_seq, {_E6}, {_D6}, event, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, event ORDER BY abs(delta) DESC, commit_hash) AS rank
        FROM v_events WHERE event IS NOT NULL) WHERE rank <= 5""",
    "entropy_trend": f"SELECT repo, n AS commit_count, {r6('trend')} AS trend FROM v_whole",
    **_signal("heat_spike"),
    **_signal("heat_wave"),
    **_signal("cold_front"),
    "percentile_position": _PERCENTILE
    + """(SELECT *, cume_dist() OVER (PARTITION BY repo ORDER BY entropy) * 100 AS percentile, n AS history_count,
           min(entropy) OVER r AS lo, avg(entropy) OVER r AS mean, max(entropy) OVER r AS hi
         FROM v_deltas WINDOW r AS (PARTITION BY repo)) WHERE history_count >= 3""",
    "percentile_position_unstored": _PERCENTILE
    + """(SELECT h.repo, any_value(h.commit_hash) AS commit_hash, any_value(h.entropy) AS entropy, count(*) AS history_count,
           count(*) FILTER (s.entropy <= h.entropy) * 100.0 / count(*) AS percentile,
           min(s.entropy) AS lo, avg(s.entropy) AS mean, max(s.entropy) AS hi
         FROM v_deltas h JOIN v_deltas s ON s.repo = h.repo AND s.commit_seq < s.n
         WHERE h.commit_seq = h.n GROUP BY h.repo) WHERE history_count >= 3""",
    "drift_level": f"SELECT repo, commit_hash, {_E6}, {_below('entropy', fixed.DRIFT_GRADES)} AS grade FROM v_metrics",
    "trend_vs_previous": f"""
      SELECT repo, commit_hash, {_E6}, {r6('step')} AS delta, CASE WHEN step > 0.02 THEN 'worsening'
        WHEN step < -0.02 THEN 'improving' WHEN step IS NOT NULL THEN 'stable' END AS trend FROM v_deltas""",
    "downsample_series": f"SELECT repo, commit_hash, commit_seq, {_E6} FROM ({_sampled(30)})",
    "growth_series": f"""
      SELECT repo, commit_hash, ts, total_sloc, total_files, {r6('total_sloc / total_files')} AS sloc_per_file FROM v_history""",
    "entropy_badge_band": f"SELECT repo, commit_hash, {_E6}, {_below('entropy', fixed.BADGE_BANDS)} AS band FROM v_metrics",
    # joins and diffs
    "history_join": f"""
      WITH known AS (SELECT * FROM v_commits WHERE repo = 'A' OR (repo = 'R' AND commit_hash >= '{views.START}')),
        joined AS (SELECT m.*, k.ts, k.parents FROM v_metrics m LEFT JOIN known k USING (repo, commit_hash))
      SELECT repo, commit_hash, total_files, total_sloc, {_E6}, coalesce(ts, '0001-01-03') AS ts,
        coalesce(len(parents), 0)::BIGINT AS parents
      FROM joined WHERE ts IS NOT NULL OR repo NOT IN (SELECT repo FROM joined WHERE ts IS NOT NULL)""",
    "metrics_chronological": f"""
      SELECT repo, commit_hash, total_files, total_sloc, {_E6}, k.ts
      FROM v_metrics LEFT JOIN (SELECT * FROM v_commits WHERE commit_hash >= '{views.START}') k USING (repo, commit_hash)""",
    "attach_function_metrics": f"""
      SELECT s.repo, s.commit_hash, s.path, {r6('coalesce(cc, 0.0)')} AS cc, coalesce(smells_high, 0)::BIGINT AS smells_high,
        coalesce(smells_medium, 0)::BIGINT AS smells_medium, coalesce(smells_low, 0)::BIGINT AS smells_low
      FROM v_source s LEFT JOIN v_doc_rollup USING (repo, commit_hash, path)""",
    "new_files": f"SELECT repo, path, {r6('current_badness')} AS badness FROM v_pairs WHERE status = 'new'",
    "removed_files": f"SELECT repo, path, {r6('baseline_badness')} AS badness FROM v_pairs WHERE status = 'removed'",
    "worsened_files": f"""
      SELECT repo, path, {r6('current_badness')} AS current_badness, {r6('baseline_badness')} AS baseline_badness, {_D6}
      FROM v_pairs WHERE status = 'worsened'""",
    "improved_files": f"""
      SELECT repo, path, {r6('current_badness')} AS current_badness, {r6('baseline_badness')} AS baseline_badness, {_D6}
      FROM v_pairs WHERE status = 'improved'""",
    "snapshot_diff": f"""
      SELECT repo, path, {r6('baseline_badness')} AS baseline_badness, {r6('current_badness')} AS current_badness, status, {_D6}, rank
      FROM (SELECT *, row_number() OVER (PARTITION BY repo, status
              ORDER BY coalesce(abs(delta), current_badness, baseline_badness) DESC, path) AS rank
            FROM v_pairs WHERE status <> 'same') WHERE rank <= 10""",
    "summary_compare": f"""
      SELECT repo, metric, {r6('baseline')} AS baseline, {r6('current')} AS current, {r6('current - baseline')} AS delta,
        {r6('CASE WHEN baseline = 0 THEN 0.0 ELSE (current - baseline) / baseline END')} AS relative_delta,
        CASE WHEN current = baseline THEN 'unchanged' WHEN (current > baseline) = (metric = 'entropy') THEN 'worse'
          ELSE 'better' END AS direction
      FROM (SELECT repo, metric, coalesce(baseline, 0.0) AS baseline, coalesce(current, 0.0) AS current
            FROM {_long_summary('v_sum_base', 'baseline')} FULL JOIN {_long_summary('v_sum_cur', 'current')} USING (repo, metric))""",
    "drift_verdict": f"""
      SELECT repo, {r6('baseline')} AS baseline_entropy, {_E6}, {r6('trend')} AS trend, {_VERDICT} AS verdict
      FROM (SELECT w.*, coalesce(b.entropy, 0.0) AS baseline FROM v_whole w
            LEFT JOIN (SELECT repo, entropy FROM v_metrics WHERE commit_hash = '{views.BASELINE}') b USING (repo))""",
    "drift_verdict_as_of": f"""
      SELECT repo, commit_hash, {r6('baseline')} AS baseline_entropy, {_E6}, {r6('trend')} AS trend,
        CASE WHEN baseline IS NOT NULL THEN {_VERDICT} END AS verdict
      FROM (SELECT *, e4 AS baseline FROM v_as_of)""",
    "observations": f"""
      WITH o AS ({_OBSERVED})
      SELECT repo, 1::BIGINT AS position, CASE WHEN abs(de) < 0.001 THEN 'entropy_unchanged' WHEN de < 0 THEN 'entropy_dropped'
          ELSE 'entropy_rose' END AS code, {r6('abs(de)')} AS amount, {r6('abs(rel)')} AS share, NULL::VARCHAR AS example FROM o
      UNION ALL SELECT repo, 2, CASE WHEN trend > 0.001 THEN 'inner_warming' WHEN trend < -0.001 THEN 'inner_cooling'
          ELSE 'inner_flat' END, {r6('abs(trend)')}, NULL, NULL FROM o WHERE n >= 3
      UNION ALL SELECT * FROM (SELECT repo, 3, CASE WHEN ds > 0 AND de <= 0 THEN 'grew_and_cooled'
          WHEN ds > 0 AND de > 0 THEN 'grew_and_rose' WHEN ds < 0 AND de < 0 THEN 'shrank_and_improved' END AS code,
          abs(ds)::DOUBLE, NULL, NULL FROM o) WHERE code IS NOT NULL
      UNION ALL SELECT repo, 4, CASE WHEN df > 0 THEN 'files_added' ELSE 'files_removed' END, abs(df)::DOUBLE, NULL, NULL
        FROM o WHERE df <> 0
      UNION ALL SELECT repo, 5, 'files_hotter', hot::DOUBLE, NULL, hot_path FROM o WHERE hot > 0
      UNION ALL SELECT repo, 6, 'files_cooler', cool::DOUBLE, NULL, cool_path FROM o WHERE cool > 0""",
    "delta_contributors": f"""
      SELECT repo, commit_hash, path, {r6('old_badness')} AS old_badness, {r6('new_badness')} AS new_badness, {_D6}, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY delta DESC, path) AS rank FROM ({_RISES})) WHERE rank <= 10""",
    "delta_bands": f"""
      SELECT repo, commit_hash, 'delta' AS scale, {_above('delta', fixed.SEVERITY_SCALES['delta'])} AS band,
        count(*)::BIGINT AS file_count FROM ({_RISES}) GROUP BY ALL""",
    "changed_files": """
      WITH linked AS (SELECT repo, commit_hash, parents[1] AS parent FROM v_commits),
        mine AS (SELECT s.*, parent FROM v_snapshots s JOIN linked USING (repo, commit_hash)),
        theirs AS (SELECT l.repo, l.commit_hash, s.path, s.content_hash
                   FROM linked l JOIN v_snapshots s ON s.repo = l.repo AND s.commit_hash = l.parent)
      SELECT repo, commit_hash, path, CASE WHEN o.content_hash IS NULL THEN 'added' WHEN m.content_hash IS NULL THEN 'deleted'
        ELSE 'modified' END AS change
      FROM (SELECT * FROM mine WHERE parent IS NOT NULL) m FULL JOIN theirs o USING (repo, commit_hash, path)
      WHERE m.content_hash IS DISTINCT FROM o.content_hash
      UNION ALL SELECT DISTINCT repo, commit_hash, string_split(path, '/')[1], 'root' FROM mine WHERE parent IS NULL""",
    "snapshot_at_commit": "SELECT * FROM v_snapshots",
    "snapshot_at_commit_branched": "SELECT * FROM v_branched_snapshots",
    "changed_files_branched": """
      WITH linked AS (SELECT b.repo, b.commit_hash, p.commit_hash AS parent FROM v_branched b LEFT JOIN v_branched p ON p.repo = b.repo AND p.n = b.p1),
        mine AS (SELECT s.*, parent FROM v_branched_snapshots s JOIN linked USING (repo, commit_hash)),
        theirs AS (SELECT l.repo, l.commit_hash, s.path, s.content_hash
                   FROM linked l JOIN v_branched_snapshots s ON s.repo = l.repo AND s.commit_hash = l.parent)
      SELECT repo, commit_hash, path, CASE WHEN o.content_hash IS NULL THEN 'added' WHEN m.content_hash IS NULL THEN 'deleted'
        ELSE 'modified' END AS change
      FROM (SELECT * FROM mine WHERE parent IS NOT NULL) m FULL JOIN theirs o USING (repo, commit_hash, path)
      WHERE m.content_hash IS DISTINCT FROM o.content_hash
      UNION ALL SELECT DISTINCT repo, commit_hash, string_split(path, '/')[1], 'root' FROM mine WHERE parent IS NULL""",
    "commits_chronological_branched": "SELECT repo, commit_hash, strftime(ts, '%Y-%m-%d') AS ts, seq AS commit_seq FROM v_settled",
    "commits_since_branched": f"""
      SELECT repo, commit_hash, strftime(ts, '%Y-%m-%d') AS ts FROM v_settled c
      WHERE seq >= (SELECT seq FROM v_settled s WHERE s.repo = c.repo AND s.commit_hash = '{views.START}')""",
    "head_commit_branched": f"""
      SELECT repo, commit_hash, strftime(ts, '%Y-%m-%d') AS ts, ((p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT)::BIGINT AS parents
      FROM v_settled WHERE commit_hash < '{views.CURRENT}'
      QUALIFY row_number() OVER (PARTITION BY repo ORDER BY seq DESC) = 1""",
    # sorting and top-k
    "top_large_files": _top("v_file_metrics", "sloc"),
    "top_complex_files": _top("v_file_metrics", "cc", "cc > 0", r6("cc") + " AS cc"),
    "top_smelly_files": _top("v_file_metrics", _W, f"{_W} > 0", f"{_W} AS weighted_smells"),
    "top_coupled_files": _top("v_file_metrics", "coupling", "coupling > 0"),
    "top_scan_chart": """
      WITH f AS (SELECT * REPLACE (CASE WHEN substr(commit_hash, 6, 2)::INT % 2 = 1 THEN 0.0 ELSE cc END AS cc) FROM v_file_metrics),
        g AS (SELECT *, max(cc > 0) OVER (PARTITION BY repo, commit_hash) AS any_cc FROM f)
      SELECT repo, commit_hash, rank, path, list_last(string_split(path, '/')) AS file_name,
        CASE WHEN any_cc THEN 'cc' ELSE 'sloc' END AS measure, CASE WHEN any_cc THEN round_even(cc, 1) ELSE sloc::DOUBLE END AS value
      FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_hash
              ORDER BY CASE WHEN any_cc THEN cc ELSE sloc END DESC, path) AS rank
            FROM g WHERE CASE WHEN any_cc THEN cc > 0 ELSE sloc > 0 END) WHERE rank <= 10""",
    "top_refactor": f"""
      SELECT repo, commit_hash, path, {r6('score')} AS score,
        {r6('score / CASE WHEN best = 0 THEN 1 ELSE best END')} AS relative_score, rank
      FROM (SELECT *, max(score) OVER (PARTITION BY repo, commit_hash) AS best,
              row_number() OVER (PARTITION BY repo, commit_hash ORDER BY score DESC, path) AS rank
            FROM (SELECT *, (s_sloc + (1.0 - s_mi)) / 2 AS score FROM v_scored)) WHERE rank <= 10""",
    "top_diffusion": _top("v_diffusion", "diffusion", "diffusion > 0", r6("diffusion") + " AS diffusion"),
    "top_badness": _top("v_scored", "badness", "badness > 0", r6("badness") + " AS badness"),
    "file_metrics_table": f"SELECT repo, commit_hash, path, {_MEASURES}, {r6('badness')} AS badness FROM v_scored",
    "head_commit": """
      SELECT repo, commit_hash, ts, len(parents)::BIGINT AS parents FROM v_commits
      QUALIFY row_number() OVER (PARTITION BY repo ORDER BY commit_seq DESC) = 1""",
    "commits_chronological": "SELECT repo, commit_hash, ts, commit_seq FROM v_commits",
    "commit_table": f"SELECT repo, commit_hash, ts, total_files, total_sloc, {_E6}, {_D6}, sloc_delta FROM v_deltas",
    # incremental and maintenance jobs
    "new_commits": f"SELECT repo, commit_hash, ts FROM v_commits WHERE commit_hash >= '{views.START}'",
    "insert_if_absent": "SELECT repo, commit_hash, path, sloc FROM v_file_metrics WHERE sloc % 2 <> 0",
    "repo_register": """
      SELECT repo, min(remote_url) AS remote_url FROM v_named
      WHERE repo NOT IN (SELECT repo FROM v_named WHERE page_id % 5 = 0) GROUP BY repo""",
    "repo_name_from_url": "SELECT repo, count(*)::BIGINT AS url_count FROM v_named GROUP BY repo",
    "repo_list": """
      SELECT repo, min(remote_url) AS remote_url, count(*) FILTER (page_id % 4 <> 0)::BIGINT AS commit_count
      FROM v_named GROUP BY repo""",
    "clear_history": f"SELECT repo, commit_hash, total_files, total_sloc, {_E6} FROM v_metrics WHERE repo <> 'N'",
    "incremental_scan_stream": f"SELECT repo, commit_hash, total_files, total_sloc, {_E6} FROM v_metrics",
    # whole commands
    "report_production": f"""
      WITH chosen AS (SELECT * FROM v_file_metrics WHERE kind = 'Production'), scored AS ({_scored('chosen', 'repo, commit_hash')}),
        m AS ({_entropy('scored', 'repo, commit_hash')})
      SELECT repo, commit_hash, coalesce(total_files, 0) AS total_files, coalesce(total_sloc, 0) AS total_sloc,
        {r6('coalesce(entropy, 0.0)')} AS entropy, ts FROM v_commits LEFT JOIN m USING (repo, commit_hash)""",
}


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in re.findall(r"\bv_[a-z_]+\b", sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found[name] = None


def statements() -> dict[str, str]:
    """Complete statements, each with the views it needs."""
    complete = {}
    for name, sql in STATEMENTS.items():
        found: dict[str, None] = {}
        _needed(sql, found)
        chain = ", ".join(f"{view} AS ({VIEWS[view]})" for view in found)
        body = sql.strip()
        if not chain:
            complete[name] = body
        elif body.upper().startswith("WITH "):
            complete[name] = f"WITH {chain}, {body[5:]}"
        else:
            complete[name] = f"WITH {chain} {body}"
    return complete
