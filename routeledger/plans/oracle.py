"""Expected results of the named queries as SQL over the base tables.

Nothing here goes through the engine: for every derived source file the expected
rows are written down from the columns it was derived from.
"""

from __future__ import annotations

from .corpus import DEPENDENCIES as PYTHON_DEPENDENCIES
from .corpus import GUARDS as PYTHON_GUARDS
from .corpus import NAMED, PARAMS, PYTHON_PLOTS, PYTHON_ROTA, PYTHON_VALVES

ORACLE: dict[str, str] = {}


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- paths ------------------------------------------------------------------------

_EXCLUDED = (
    "['.git', '.hg', '.svn', '.idea', '.vscode', '__pycache__', '.venv', 'venv', 'env', '.env', "
    "'.tox', '.mypy_cache', '.pytest_cache', 'site-packages', '.eggs', 'build', 'dist', "
    "'node_modules', 'bower_components', 'target', '.gradle', 'out', 'tests', 'test', "
    "'__tests__', 'examples', 'example', 'fixtures']"
)
_PATHS = """paths AS (
  SELECT lower(p_brand) AS repo,
    (['src','tests','lib/build','node_modules/x','SRC/Tests','pkg/out/a','testing'])[p_partkey % 7 + 1]
    || '/f' || p_partkey
    || (['.py','.PY','.java','.js','.tsx','.mjs','.go','.cjs','/tests'])[p_size % 9 + 1] AS rel_path
  FROM part)"""


def _kept(excluded: str) -> str:
    return f"""kept AS (
  SELECT *, CASE WHEN lower(rel_path) LIKE '%.py' THEN 'python'
                 WHEN lower(rel_path) LIKE '%.java' THEN 'java'
                 WHEN regexp_matches(lower(rel_path), '[.](js|jsx|ts|tsx|mjs|cjs)$')
                 THEN 'javascript' END AS language
  FROM paths
  WHERE NOT list_has_any(string_split(rel_path, '/')[:-2], {excluded}))"""


ORACLE["scan_filter"] = _with(
    _PATHS, _kept(_EXCLUDED), select="SELECT repo, rel_path FROM kept WHERE language IS NOT NULL"
)
ORACLE["tree_scan"] = """
SELECT lower(source) AS repo,
  (['src', '', 'lib/core', '', '', 'docs', ''])[doc_id % 7 + 1] || '/d' || doc_id
    || (['.py', '.java', '.TS', '.md', '.js'])[doc_id % 5 + 1] AS rel_path,
  (['python', 'java', 'javascript', '', 'javascript'])[doc_id % 5 + 1] AS language,
  length(text) AS n_chars, md5(text) AS digest
FROM documents WHERE doc_id % 7 IN (0, 2, 5) AND doc_id % 5 <> 3 AND text IS NOT NULL AND source IS NOT NULL"""
ORACLE["scan_filter_override"] = _with(
    _PATHS, _kept("['src', 'out']"),
    select="SELECT repo, rel_path FROM kept WHERE language IS NOT NULL",
)
ORACLE["lang_dispatch"] = _with(
    _PATHS, _kept(_EXCLUDED),
    select="SELECT repo, language, count(*) AS n_files FROM kept WHERE language IS NOT NULL GROUP BY 1, 2",
)
ORACLE["parse_errors"] = """
SELECT lower(p_brand) AS repo, 'api/part_' || p_partkey || '.py' AS rel_path, 'SyntaxError' AS reason
FROM part WHERE p_partkey % 97 = 96 AND p_partkey % 11 <> 10"""

_RAW = """raw AS (
  SELECT page_id AS k, replace(
      regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/[0-9]+', '/%p%', 'g'), '%p%',
      (['{id}', '<int:id>', '<slug>', ':id', '{f:path}'])[page_id % 5 + 1]) AS styled
  FROM pages),
shaped AS (
  SELECT k, CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN styled || '///' WHEN 2 THEN substr(styled, 2)
                       WHEN 3 THEN '//' ELSE styled END AS raw FROM raw),
rooted AS (
  SELECT k, CASE WHEN rtrim(raw, '/') LIKE '/%' THEN rtrim(raw, '/') ELSE '/' || rtrim(raw, '/') END AS p
  FROM shaped),
normal AS (
  SELECT k, regexp_replace(regexp_replace(p, '<(?:[\\p{L}\\p{N}_]+:)?([\\p{L}\\p{N}_]+)>', ':\\1', 'g'),
                           '\\{([\\p{L}\\p{N}_]+)\\}', ':\\1', 'g') AS path FROM rooted)"""
ORACLE["normalized_paths"] = _with(_RAW, select="SELECT k AS page_id, path FROM normal")
ORACLE["path_shapes"] = _with(
    _RAW,
    select="SELECT regexp_replace(path, ':[\\p{L}\\p{N}_]+', ':{}', 'g') AS shape, count(*) AS n "
    "FROM normal GROUP BY 1",
)
ORACLE["normalized_rows"] = """
WITH f AS (
  SELECT o_orderkey AS k, (['FastAPI','Flask','Spring','Spring Boot','Spring Boot','Express','Gin',''])
           [o_orderkey % 8 + 1] AS framework FROM orders)
SELECT '/o/' || k AS path, (['GET','POST','DELETE'])[k % 3 + 1] AS method, framework,
  CASE WHEN k % 5 = 0 THEN 'kotlin' WHEN framework IN ('FastAPI','Flask') THEN 'python'
       WHEN framework LIKE 'Spring%' THEN 'java' WHEN framework = 'Express' THEN 'javascript' END AS language,
  false AS auth_required, false AS is_new, framework = '' AS rejected
FROM f"""

# --- authentication words ---------------------------------------------------------

_CFG = """brands AS (
  SELECT DISTINCT lower(p_brand) AS repo, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS n FROM part),
defaults AS (
  SELECT repo, n, CASE WHEN n % 10 = 9 THEN 4 ELSE n % 5 END AS v,
    ['jwt','login','auth','token','security','permission','verify','secure'] AS kw,
    ['current_user','currentuser','current_active','get_current','active_user','authenticated','oauth',
     'apikey','api_key','bearer','scope','principal'] AS hint,
    ['PreAuthorize','PostAuthorize','Secured','RolesAllowed','PreFilter','PostFilter'] AS spring,
    ['auth','authenticate','requireauth','requirelogin','ensureauthenticated','ensureloggedin',
     'isauthenticated','passport','verifytoken','checkjwt','jwtcheck','protect','authguard','authorize'] AS express
  FROM brands),
cfg AS (
  SELECT repo, n,
    CASE v WHEN 0 THEN ['Gatekeeper','cached'] WHEN 1 THEN list_append(kw, 'gatekeeper')
           WHEN 2 THEN ['only'] ELSE kw END AS kw,
    CASE v WHEN 3 THEN list_append(hint, 'Tenant') ELSE hint END AS hint,
    CASE v WHEN 1 THEN list_append(spring, 'Inner') ELSE spring END AS spring,
    CASE v WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE express END AS express
  FROM defaults)"""
ORACLE["auth_config"] = _with(
    _CFG,
    select="SELECT repo, field, coalesce(array_to_string(list_sort(words), ','), '') AS words FROM (\n"
    + " UNION ALL ".join(
        f"SELECT repo, n, '{field}' AS field, {words} AS words FROM cfg"
        for field, words in [
            ("keywords", "kw"),
            ("python_dependency_callables", "['Depends', 'Security']"),
            ("python_auth_dependency_hints", "hint"),
            ("spring_auth_annotations", "spring"),
            ("express_auth_middleware", "express"),
        ]
    )
    + ") WHERE n % 10 <> 9",
)


def _named(names: list[str]) -> str:
    quoted = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"""named AS (
  SELECT p_partkey, replace(([{quoted}])[p_partkey % {len(names)} + 1], '%n%', replace(p_name, ' ', '_')) AS name,
    cfg.* FROM part JOIN cfg ON cfg.repo = lower(p_brand))"""


def _any(words: str, text: str) -> str:
    return f"(len(list_filter({words}, lambda w: contains(lower({text}), lower(w)))) > 0)"


def _predicate(names: list[str], test: str) -> str:
    return _with(
        _CFG, _named(names), select=f"SELECT p_partkey, name, coalesce({test}, false) AS is_auth FROM named"
    )


ORACLE["auth_keyword"] = _predicate(
    ["login_%n%", "get_%n%", "VerifyAll", "author_%n%", "Cached_%n%", "gatekeeper", "onlyOne", ""],
    "name <> '' AND " + _any("kw", "name"),
)
_CALLS = "regexp_extract_all(name, '\\b(Depends|Security)\\(\\s*([A-Za-z_][A-Za-z0-9_.]*)', 2)"
ORACLE["auth_dep"] = _predicate(
    [
        "Depends(get_db)", "Depends( get_current_user )", "Security(oauth2.%n%)", "MyDepends(login)",
        "Annotated[str, Depends(db), Depends(tenant_of)]", "Body(token)", "[Depends(only_%n%)]",
    ],
    f"len(list_filter({_CALLS}, lambda c: {_any('list_concat(kw, hint)', 'c')})) > 0",
)
ORACLE["auth_spring"] = _predicate(
    ["PreAuthorize", "GetMapping", "MyRolesAllowed", "securedBy", "InnerOnly", "Login"],
    _any("spring", "name"),
)
ORACLE["auth_express"] = _predicate(
    ["requireAuth", "cors", "passportInit", "protectRoute", "cachedView", "helmet", "jwtCheck"],
    _any("list_concat(express, kw)", "name"),
)
_CALLEE = (
    "CASE WHEN contains(name, '(') THEN trim(regexp_extract(split_part(name, '(', 1), '([^.]*)$', 1)) "
    "WHEN NOT contains(name, '.') AND regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$.]*$') THEN name END"
)
ORACLE["auth_argument"] = _predicate(
    [
        "requireAuth", "authController.list", "auth('x', y)", "passport.authenticate('jwt')",
        "a.b.c(d)", "(req, res) => auth(req)", "function authHandler(a)", "%n%", "ctrl.login(x)",
    ],
    f"({_CALLEE}) <> '' AND " + _any("list_concat(express, kw)", f"({_CALLEE})"),
)

# --- Python -----------------------------------------------------------------------

_PY = """modules AS (
  SELECT p_partkey AS k, lower(p_brand) AS repo, '/' || lower(p_type) AS kind, p_size AS size,
    'api/part_' || p_partkey || '.py' AS source_file, 'bed' || (p_partkey % 5) AS var
  FROM part WHERE p_partkey % 11 <> 10 AND p_partkey % 97 <> 96),
cand AS (
  SELECT k, size, repo, source_file, 12 AS line_number, var AS caller, '/valves/{valve}/flow' AS raw_path,
    kind AS local_prefix, 'FastAPI' AS framework, ['POST'] AS methods, size % 4 = 0 AS auth_local,
    CASE WHEN size % 4 = 0 THEN 'Argument by default: Security(verify_badge)' END AS auth_info,
    size % 4 = 2 AS by_alias, 'flow' AS what FROM modules WHERE k % 3 = 0
  UNION ALL
  SELECT k, size, repo, source_file, 17, var, '/valves/{valve}', kind, 'FastAPI', ['DELETE'], size % 3 = 1,
    CASE WHEN size % 3 = 1 THEN 'Decorator dependencies: [Depends(badge_token)]' END, false, 'close'
  FROM modules WHERE k % 3 = 0
  UNION ALL
  SELECT k, size, repo, source_file, 8, var, '/rota/', kind, 'FastAPI', ['GET', 'HEAD'],
    size % 4 = 0 OR size % 3 = 1,
    nullif(concat_ws('; ', CASE WHEN size % 4 = 0 THEN 'Argument who default: Depends(get_principal)' END,
      CASE WHEN size % 3 = 1 THEN 'Decorator dependencies: [Depends(badge_token)]' END), ''), false, 'rota'
  FROM modules WHERE k % 3 = 1
  UNION ALL
  SELECT k, size, repo, source_file, 13, var, '/rota/{day}/', kind, 'FastAPI', ['GET'], false, NULL, false, 'day'
  FROM modules WHERE k % 3 = 1
  UNION ALL
  SELECT k, size, repo, source_file, 9, 'plots', '/plot/<int:row>/soil', kind, 'Flask', ['GET', 'PATCH'],
    size % 2 = 0, CASE WHEN size % 2 = 0 THEN 'Flask Decorators: login_required' END, false, 'soil'
  FROM modules WHERE k % 3 = 2
  UNION ALL
  SELECT k, size, repo, source_file, 14, 'plots', '/plot', kind, 'Flask', ['GET'], false, NULL, false, 'listing'
  FROM modules WHERE k % 3 = 2),
py AS (
  SELECT repo,
    CASE caller WHEN 'bed0' THEN '/north' WHEN 'bed1' THEN '/south-wing' WHEN 'plots' THEN '/estate' ELSE '' END
      || local_prefix
      || CASE what WHEN 'flow' THEN '/valves/:valve/flow' WHEN 'close' THEN '/valves/:valve' WHEN 'rota' THEN '/rota'
           WHEN 'day' THEN '/rota/:day' WHEN 'soil' THEN '/plot/:row/soil' ELSE '/plot' END AS path,
    unnest(methods) AS method, auth_local OR by_alias AS auth_required,
    CASE WHEN by_alias THEN 'alias dependency: Warden' ELSE auth_info END AS auth_info,
    source_file, line_number, framework, 'python' AS language, caller, what, k, size
  FROM cand)"""
_COLUMNS = "repo, path, method, auth_required, auth_info, source_file, line_number, framework, language"
ORACLE["py_prefix"] = """
SELECT DISTINCT lower(p_brand) AS repo, v.router_var, v.prefix
FROM part, (VALUES ('bed0', '/north'), ('bed1', '/south-wing'), ('plots', '/estate')) AS v(router_var, prefix)"""
ORACLE["py_auth"] = _with(
    _PY,
    select="SELECT repo, source_file AS rel_path, line_number, caller, raw_path, local_prefix, framework, "
    "array_to_string(methods, ',') AS methods, auth_local, auth_info FROM cand",
)
ORACLE["alias_auth"] = _with(
    _PY,
    select="SELECT repo, 'Warden' AS alias_expr, count(*) AS n_routes FROM cand WHERE by_alias GROUP BY 1",
)
ORACLE["py_endpoints"] = _with(_PY, select=f"SELECT {_COLUMNS} FROM py")

# --- logical lines ----------------------------------------------------------------

_WS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
    "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)


def _lines(dotted: str) -> str:
    """A walk from line to line that carries the open balance and the text so far."""
    return f"""
WITH RECURSIVE texts AS (
  SELECT source AS repo, CAST(doc_id AS VARCHAR) AS doc, regexp_split_to_array(
    replace(replace(translate(text, 'xqkw', '()()'), chr(10) || 'T', chr(10) || ' .T'),
            chr(10) || 'L', chr(10) || chr(9) || '.L'),
    '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS parts
  FROM documents),
numbered AS (
  SELECT repo, doc, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos, len(parts) AS n FROM texts),
l AS (
  SELECT repo, doc, pos, raw, trim(raw, {_WS}) AS bare,
    len(replace(raw, ')', '')) - len(replace(raw, '(', '')) AS d
  FROM numbered WHERE NOT (pos = n AND raw = '')),
walk AS (
  SELECT repo, doc, pos, pos AS start_line, d AS bal, raw AS body FROM l WHERE pos = 1
  UNION ALL
  SELECT l.repo, l.doc, l.pos,
    CASE WHEN w.bal > 0 OR {dotted} THEN w.start_line ELSE l.pos END,
    CASE WHEN w.bal > 0 OR {dotted} THEN w.bal + l.d ELSE l.d END,
    CASE WHEN w.bal > 0 THEN w.body || ' ' || l.bare
         WHEN {dotted} THEN rtrim(w.body, {_WS}) || l.bare ELSE l.raw END
  FROM walk w JOIN l ON l.repo = w.repo AND l.doc = w.doc AND l.pos = w.pos + 1)
SELECT repo, doc, start_line, trim(arg_max(body, pos), {_WS}) AS text FROM walk GROUP BY repo, doc, start_line"""


ORACLE["logical_lines_plain"] = _lines("false")
ORACLE["logical_lines_fluent"] = _lines("starts_with(l.bare, '.')")

# --- Java -------------------------------------------------------------------------

_JAVA = """ctl AS (
  SELECT s_suppkey AS k, 'java-' || (s_suppkey % 7) AS repo, 'src/C' || s_suppkey || '.java' AS source_file,
    '/' || lower(n_name) AS prefix, s_suppkey % 2 = 0 AND s_suppkey % 5 = 0 AS guarded,
    CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS shift, s_suppkey % 6 = 2 AS swallowed,
    s_suppkey % 4 = 0 AS cut_off
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
found AS (
  SELECT *, prefix || '/c' || k || '/:berth/gate' AS path, ['PUT'] AS methods, 12 + shift AS line_number,
    'Secured' AS guard FROM ctl WHERE k % 2 = 0 AND NOT swallowed
  UNION ALL
  SELECT *, prefix, ['DELETE'], 19 + shift, NULL FROM ctl WHERE k % 2 = 0 AND NOT swallowed
  UNION ALL
  SELECT *, prefix || '/c' || k || '/slots', ['GET', 'OPTIONS'], 24 + shift,
    CASE WHEN NOT cut_off THEN 'PostAuthorize' END FROM ctl WHERE k % 2 = 0 AND NOT swallowed
  UNION ALL
  SELECT *, prefix || '/q' || k, ['GET'], 7, 'PreAuthorize' FROM ctl WHERE k % 2 = 1
  UNION ALL
  SELECT *, prefix || '/q' || k || '/:slip', ['PATCH'], 11, NULL FROM ctl WHERE k % 2 = 1),
java AS (
  SELECT repo, path, unnest(methods) AS method, guarded OR guard IS NOT NULL AS auth_required,
    nullif(concat_ws('; ', CASE WHEN guarded THEN 'class-level authorization' END, 'annotations: ' || guard), '')
      AS auth_info,
    source_file, line_number, 'Spring Boot' AS framework, 'java' AS language FROM found)"""
ORACLE["java_endpoints"] = _with(_JAVA, select=f"SELECT {_COLUMNS} FROM java")

# --- JavaScript -------------------------------------------------------------------

ORACLE["js_mounts"] = """
SELECT DISTINCT lower(c_mktsegment) AS repo, v.router_ident, v.prefix, v.has_auth
FROM customer, (VALUES ('shelf0', '/yard', false), ('shelf1', '/loft', true), ('shelf3', '/cellar/new', false))
  AS v(router_ident, prefix, has_auth)"""
_JS = """cust AS (
  SELECT c_custkey AS k, lower(c_mktsegment) AS repo, 'routes/c' || c_custkey || '.js' AS source_file,
    (['/yard', '/loft', '', '/cellar/new', '', ''])[c_custkey // 3 % 6 + 1] AS prefix,
    CASE WHEN c_custkey // 3 % 6 = 1 THEN 'mount-level middleware on ' || chr(39) || 'shelf1' || chr(39) END AS mounted
  FROM customer),
declared AS (
  SELECT *, prefix || '/k' || k || '/:kiln/heat' AS path, ['PUT'] AS methods, 5 AS line_number,
    ([NULL, 'requireLogin', 'jwtCheck({ aud: ''kiln'' })'])[k // 3 % 3 + 1] AS hit FROM cust WHERE k % 3 = 0
  UNION ALL
  SELECT *, prefix || '/k' || k || '/glazes', ['GET'], 9, NULL FROM cust WHERE k % 3 = 0
  UNION ALL
  SELECT *, prefix || '/k' || k || '/glazes', ['DELETE'], 9, 'ensureLoggedIn' FROM cust WHERE k % 3 = 0
  UNION ALL
  SELECT *, prefix || '/k' || k || '/ash', ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'], 3, NULL
  FROM cust WHERE k % 3 = 1
  UNION ALL
  SELECT *, prefix || '/k' || k || '/clay/:lot', ['PATCH'], 4, 'protectLot()' FROM cust WHERE k % 3 = 1
  UNION ALL
  SELECT *, prefix || '/k' || k || '/clay/:lot', ['POST'], 4, NULL FROM cust WHERE k % 3 = 1
  UNION ALL
  SELECT * REPLACE (NULL AS mounted), '/k' || k || '/any',
    [(['OPTIONS', 'GET', 'DELETE', 'PATCH'])[k % 4 + 1]], 2, NULL FROM cust WHERE k % 3 = 2
  UNION ALL
  SELECT *, prefix || '/k' || k || '/fire', ['POST'], 3, 'passport.authenticate("bearer")' FROM cust WHERE k % 3 = 2),
js AS (
  SELECT repo, path, unnest(methods) AS method, mounted IS NOT NULL OR hit IS NOT NULL AS auth_required,
    nullif(concat_ws('; ', mounted, 'inline middleware: ' || hit), '') AS auth_info,
    source_file, line_number, 'Express' AS framework, 'javascript' AS language FROM declared)"""
ORACLE["js_endpoints"] = _with(_JS, select=f"SELECT {_COLUMNS} FROM js")

_ALL = f"""every_row AS (
  SELECT {_COLUMNS} FROM py UNION ALL SELECT {_COLUMNS} FROM java UNION ALL SELECT {_COLUMNS} FROM js)"""
ORACLE["endpoints_all"] = _with(_PY, _JAVA, _JS, _ALL, select=f"SELECT {_COLUMNS} FROM every_row")
ORACLE["auth_info"] = _with(
    _PY, _JAVA, _JS, _ALL,
    select="SELECT language, framework, auth_required, auth_info, count(*) AS n FROM every_row "
    "GROUP BY 1, 2, 3, 4",
)

# --- runtime ----------------------------------------------------------------------

_RUNTIME = """rt AS (
  SELECT 'rt-' || (user_id % 10) AS repo, '/' || event_type || '/:id' AS path, 'POST' AS method,
    event_id % 3 = 0 AS auth_required,
    CASE WHEN event_id % 3 = 0 THEN 'runtime middleware: requireAuth (chain: helmet, requireAuth, '
      || event_type || ')' END AS auth_info,
    'app' || (event_id % 4) || '.js' AS source_file, 0 AS line_number, 'Express' AS framework,
    'javascript' AS language FROM events
  UNION ALL
  SELECT 'rt-' || (user_id % 10), '/', 'GET', false, NULL, 'app' || (event_id % 4) || '.js', 0, 'Express',
    'javascript' FROM events)"""
ORACLE["runtime_invalid"] = """
SELECT 'rt-' || (user_id % 10) AS repo, 'srv/app' || (event_id % 4) || '.js' AS entry,
  (['not JSON', 'error: no module'])[event_id % 5] AS reason
FROM events WHERE event_id % 5 IN (1, 2)"""
ORACLE["runtime_routes"] = _with(_RUNTIME, select=f"SELECT {_COLUMNS} FROM rt")

ORACLE["endpoints_runtime"] = _with(
    _PY, _JAVA, _JS, _ALL, _RUNTIME,
    f"""live AS (
  SELECT * REPLACE (CASE WHEN replace(repo, 'rt-', '')::INT % 2 = 0 THEN 'building' ELSE 'furniture' END AS repo)
  FROM rt)""",
    select=f"""SELECT {_COLUMNS} FROM every_row
WHERE language <> 'javascript' OR repo NOT IN (SELECT repo FROM live)
UNION ALL SELECT {_COLUMNS} FROM live""",
)
_BRAND = "CAST(regexp_extract(repo, '([0-9]+)', 1) AS INT) % 3"
# Under the keyword "ledger" alone, what the usual words found is gone and Ledger is an alias.
ORACLE["endpoints_configured"] = _with(
    _PY,
    f"""told AS (SELECT *, {_BRAND} AS lists FROM py),
judged AS (
  SELECT * EXCLUDE (auth_info), CASE
    WHEN lists = 0 AND what = 'soil' AND size % 2 = 1 THEN 'Flask Decorators: timed'
    WHEN lists <> 1 THEN auth_info
    WHEN what = 'flow' AND size % 4 = 1 THEN 'Argument book default: Depends(open_ledger)'
    WHEN what = 'flow' AND size % 4 = 2 THEN 'alias dependency: Warden'
    WHEN what = 'close' AND size % 3 = 2 THEN 'Decorator dependencies: [Depends(open_ledger)]'
    WHEN what = 'rota' THEN nullif(concat_ws('; ',
      CASE WHEN size % 4 = 0 THEN 'Argument who default: Depends(get_principal)' END,
      CASE WHEN size % 3 = 2 THEN 'Decorator dependencies: [Depends(open_ledger)]' END), '')
    WHEN what = 'day' THEN 'alias dependency: Ledger' END AS auth_info
  FROM told)""",
    select="SELECT repo, path, method, auth_info IS NOT NULL AS auth_required, auth_info, source_file, line_number, "
    "framework, language FROM judged",
)

_OBSERVED = """observed AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'mono' ELSE 'svc-' || (l_suppkey % 40) END AS repo,
    '/v' || (CAST(l_quantity AS INT) % 3) || '/p' || (l_partkey % 150)
      || (['/:key', '/:item', '/:id'])[l_linenumber % 3 + 1] AS path,
    '/v' || (CAST(l_quantity AS INT) % 3) || '/p' || (l_partkey % 150) || '/:{}' AS shape,
    (['GET', 'POST', 'PUT', 'DELETE'])[l_suppkey % 4 + 1] AS method, l_partkey % 5 <> 0 AS auth_required,
    'app\\m' || (l_orderkey % 500) || '.py' AS source_file, CAST(l_partkey % 90 AS INT) AS line_number,
    (['FastAPI', 'Flask', 'Spring Boot'])[l_linenumber % 3 + 1] AS framework,
    (['python', 'python', 'java'])[l_linenumber % 3 + 1] AS language,
    (l_orderkey + l_partkey) % 9 = 0 AS is_new
  FROM lineitem)"""
_REGISTRY = """spec_keys AS (
  SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'mono' ELSE 'svc-' || (l_suppkey % 40) END AS repo,
    l_partkey % 150 AS p, CAST(l_quantity AS INT) % 3 AS v FROM lineitem),
reg AS (
  SELECT repo, '/v' || v || '/p' || p || '/:key' AS path, '/v' || v || '/p' || p || '/:{}' AS shape,
    unnest(CASE WHEN p % 2 = 0 THEN ['GET', 'POST'] ELSE ['GET', 'DELETE'] END) AS method
  FROM spec_keys WHERE (p + v) % 3 <> 0 AND repo <> 'svc-7' AND p % 11 <> 0
  UNION ALL SELECT 'idle', '/ping', '/ping', 'HEAD' FROM region WHERE r_regionkey = 0)"""
ORACLE["registry"] = _with(_REGISTRY, select="SELECT DISTINCT repo, path, shape, method FROM reg")
ORACLE["registry_invalid"] = (
    "SELECT 'broken' AS repo, 'not a JSON object' AS reason FROM region WHERE r_regionkey = 1"
)
ORACLE["runtime_supersede"] = _with(
    _OBSERVED, _RUNTIME,
    select="""SELECT repo, language, line_number = 0 AS at_runtime, count(*) AS n,
  count(*) FILTER (WHERE auth_required) AS n_auth
FROM (
  SELECT repo, CASE WHEN line_number % 2 = 0 THEN 'javascript' ELSE language END AS language, line_number,
    auth_required
  FROM observed
  WHERE NOT (line_number % 2 = 0 AND repo IN (SELECT replace(repo, 'rt-', 'svc-') FROM rt))
  UNION ALL SELECT replace(repo, 'rt-', 'svc-'), language, line_number, auth_required FROM rt)
GROUP BY 1, 2, 3""",
)
ORACLE["router_flatten"] = """
WITH RECURSIVE guards AS (
  SELECT 'guard' || (o_orderkey // 50 % 5) AS name, min(o_orderkey * 8) AS pos
  FROM orders WHERE o_orderkey % 50 = 7 GROUP BY 1),
ordered AS (SELECT list({'name': name, 'pos': pos} ORDER BY pos) AS g FROM guards),
deep AS (
  SELECT s_suppkey AS s, '/d' || s_suppkey AS prefix, ['m' || (s_suppkey % 7)] AS mw FROM supplier WHERE s_suppkey = 0
  UNION ALL
  SELECT s_suppkey, prefix || '/d' || s_suppkey, list_append(mw, 'm' || (s_suppkey % 7))
  FROM supplier JOIN deep ON s = s_suppkey // 3 AND s_suppkey > 0),
named AS (
  SELECT s, prefix, mw || ['requireAuth', 'm3'] AS mw FROM deep),
before AS (
  SELECT n.n_nationkey, n.n_regionkey, list('mw' || e.n_nationkey ORDER BY e.n_nationkey) AS mw
  FROM nation n JOIN nation e ON e.n_regionkey = n.n_regionkey AND e.n_nationkey <= n.n_nationkey
  GROUP BY 1, 2)
SELECT 'app' || n_regionkey AS app, '/r' || n_regionkey || '/n' || n_nationkey || '/api/s' || s_suppkey AS path,
  'GET' AS method, 'helmet,' || array_to_string(mw, ',')
    || CASE WHEN s_suppkey * 2 + 1 > 50 THEN ',audit' ELSE '' END || ',requireAuth' AS middleware
FROM supplier JOIN before ON s_nationkey = n_nationkey
UNION ALL
SELECT 'app' || r_regionkey, '/health', unnest(['GET', 'HEAD']), 'helmet' FROM region
UNION ALL
SELECT 'wide', '/w' || (l_orderkey * 8 + l_linenumber), 'PUT', array_to_string(list_append(
  list_transform(list_filter(coalesce(g, []), lambda x: x.pos < l_orderkey * 8 + l_linenumber), lambda x: x.name),
  'pack'), ',')
FROM lineitem, ordered
UNION ALL
SELECT 'deep', prefix || '/leaf', 'POST', array_to_string(list_filter(mw, lambda x, i: list_position(mw, x) = i), ',')
FROM named"""

# --- comparison -------------------------------------------------------------------

_MATCHES = """shapes AS (SELECT DISTINCT repo, shape, method FROM reg),
matches AS (
  SELECT o.*, s.repo IS NOT NULL AS registered,
    CASE WHEN s.repo IS NULL THEN 'shadow' WHEN NOT auth_required THEN 'missing_auth' ELSE 'documented' END AS status
  FROM observed o LEFT JOIN shapes s ON s.repo = o.repo AND s.shape = o.shape AND s.method = o.method)"""
_COMPARED = (_OBSERVED, _REGISTRY, _MATCHES)
ORACLE["match_exact"] = _with(
    *_COMPARED,
    select="SELECT repo, path, method FROM observed INTERSECT SELECT repo, path, method FROM reg",
)
ORACLE["match_shape"] = _with(
    *_COMPARED, select="SELECT DISTINCT repo, path, method, registered FROM matches"
)
ORACLE["match_status"] = _with(
    *_COMPARED,
    select="SELECT repo, path, method, source_file, line_number, registered, status FROM matches",
)
ORACLE["shadow_list"] = _with(
    *_COMPARED,
    select="SELECT repo, method, path, framework, source_file || ':' || line_number AS location "
    "FROM matches WHERE NOT registered",
)
ORACLE["missing_auth_list"] = _with(
    _OBSERVED,
    select="SELECT repo, method, path, framework, source_file || ':' || line_number AS location "
    "FROM observed WHERE NOT auth_required",
)
_POSTURE = """repos AS (SELECT repo FROM observed UNION SELECT repo FROM reg),
ratios AS (
  SELECT repo, avg(CASE WHEN registered THEN 1.0 ELSE 0.0 END) AS ratio
  FROM (SELECT DISTINCT repo, path, method, registered FROM matches) GROUP BY repo),
tally AS (
  SELECT repo, count(*) AS parsed, count(*) FILTER (WHERE status = 'shadow') AS shadow,
    count(*) FILTER (WHERE NOT auth_required) AS bare, count(*) FILTER (WHERE is_new) AS fresh
  FROM matches GROUP BY repo),
known AS (SELECT repo, count(*) AS n FROM (SELECT DISTINCT repo, path, method FROM reg) GROUP BY repo),
posture AS (
  SELECT repo, coalesce(parsed, 0) AS parsed_routes_count, coalesce(n, 0) AS registered_routes_count,
    coalesce(shadow, 0) AS shadow_count, coalesce(bare, 0) AS missing_auth_count, coalesce(fresh, 0) AS new_count,
    round(coalesce(ratio, 1.0), 6) AS coverage_ratio, coalesce(ratio, 1.0) AS exact_ratio
  FROM repos LEFT JOIN ratios USING (repo) LEFT JOIN tally USING (repo) LEFT JOIN known USING (repo))"""
ORACLE["coverage_ratio"] = _with(
    *_COMPARED, _POSTURE, select="SELECT repo, coverage_ratio FROM posture"
)
ORACLE["posture"] = _with(
    *_COMPARED, _POSTURE,
    select="SELECT repo, parsed_routes_count, registered_routes_count, shadow_count, missing_auth_count, "
    "new_count, coverage_ratio FROM posture",
)
ORACLE["posture_summary"] = _with(
    *_COMPARED, _POSTURE,
    select="SELECT repo, parsed_routes_count, shadow_count, missing_auth_count, coverage_ratio, "
    "CASE WHEN coverage_ratio >= 1 THEN 'green' WHEN coverage_ratio >= 0.8 THEN 'yellow' ELSE 'red' END AS band "
    "FROM posture",
)
_VIOLATIONS = "(CASE WHEN registered THEN 0 ELSE 1 END) + (CASE WHEN auth_required THEN 0 ELSE 1 END)"
ORACLE["gate"] = _with(
    *_COMPARED,
    select=f"SELECT repo, CAST(sum({_VIOLATIONS}) AS BIGINT) AS violations, sum({_VIOLATIONS}) = 0 AS passed "
    "FROM matches GROUP BY repo",
)
ORACLE["gate_new_only"] = _with(
    *_COMPARED, "keys AS (SELECT DISTINCT repo, path, method, true AS has_new FROM matches WHERE is_new)",
    select=f"""SELECT repo, CAST(sum(CASE WHEN has_new THEN {_VIOLATIONS} ELSE 0 END) AS BIGINT) AS violations,
  sum(CASE WHEN has_new THEN {_VIOLATIONS} ELSE 0 END) = 0 AS passed
FROM matches LEFT JOIN keys USING (repo, path, method) GROUP BY repo""",
)
ORACLE["compare_rows"] = _with(
    *_COMPARED,
    select="SELECT repo, framework, language, status, count(*) AS n FROM matches GROUP BY 1, 2, 3, 4",
)

# --- provenance -------------------------------------------------------------------

_HISTORY = """log AS (
  SELECT o_orderkey AS k, o_orderkey // 3 AS i, 'h' || (o_orderkey % 3) AS repo, o_orderdate AS made,
    'dev' || o_custkey AS author, md5(CAST(o_orderkey AS VARCHAR)) || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)
      AS sha
  FROM orders),
tips AS (SELECT repo, max(i) AS head, max(i) * 6 // 10 // 4 * 4 AS v1 FROM log WHERE i % 4 <> 3 GROUP BY repo),
live AS (SELECT log.*, v1 FROM log JOIN tips USING (repo) WHERE i <= head AND i % 20 <> 19),
since_ref AS (SELECT * FROM live WHERE i > v1),
since_date AS (SELECT * FROM live WHERE made >= TIMESTAMP '1999-06-01')"""
_FILES = """mine AS (
  SELECT p, line, CASE WHEN k < 1 THEN k + 3 ELSE k END AS k FROM (
    SELECT l_partkey AS p, l_linenumber AS line,
      l_orderkey - ((l_orderkey - l_partkey) % 3 + 3) % 3 AS k FROM lineitem)),
blamed AS (SELECT p, line, max(k) AS k FROM mine GROUP BY p, line),
born AS (SELECT p, min(k) AS k FROM mine GROUP BY p)"""


def _at_line(part: str, n: str) -> str:
    """The line of a part's n-th endpoint: somewhere in the n-th block of twelve."""
    return f"CASE WHEN {n} = 0 THEN 0 ELSE ({n} - 1) * 12 + 1 + ({part} + {n}) % 12 END"


ORACLE["blame_ranges"] = _with(
    _HISTORY, _FILES,
    """apart AS (
  SELECT p, line, k, line - row_number() OVER (PARTITION BY p, k ORDER BY line) AS run FROM blamed)""",
    select="SELECT repo, 'svc/api/part_' || p || '.py' AS path, min(line) AS first, max(line) AS last, sha "
    "FROM apart JOIN log USING (k) GROUP BY repo, p, run, sha",
)
ORACLE["prov_date_window"] = _with(_HISTORY, select="SELECT repo, sha FROM since_date")
ORACLE["prov_ref_window"] = _with(_HISTORY, select="SELECT repo, sha FROM since_ref")
ORACLE["prov_added"] = """
SELECT 'h' || (p_partkey % 3) AS repo, 'svc/api/part_' || p_partkey || '.py' AS path FROM part WHERE p_size > 30"""
# Equal stubs pair by the order of their paths; the surplus of new ones stays added.
ORACLE["prov_added_renamed"] = """
WITH p AS (
  SELECT 'h' || (p_partkey % 3) AS repo, p_partkey AS k,
    (['stayed','stayed','moved','edited','replaced','stub','new','stub','moved','newstub'])[p_partkey % 10 + 1] AS fate
  FROM part),
now AS (
  SELECT repo, 'z' || k || '/index.py' AS path, row_number() OVER (PARTITION BY repo ORDER BY 'z' || k || '/index.py') AS n
  FROM p WHERE fate IN ('stub', 'newstub')),
before AS (
  SELECT repo, 'a' || k || '/index.py' AS old_path,
    row_number() OVER (PARTITION BY repo ORDER BY 'a' || k || '/index.py') AS n
  FROM p WHERE fate = 'stub')
SELECT repo, path, CASE WHEN old_path IS NULL THEN 'added' ELSE 'renamed' END AS change, old_path,
  CASE WHEN old_path IS NOT NULL THEN 1.0::DOUBLE END AS score
FROM now LEFT JOIN before USING (repo, n)
UNION ALL SELECT repo, 'svc/part_' || k || '.py', 'renamed', 'app/part_' || k || '.py', 1.0::DOUBLE FROM p WHERE fate = 'moved'
UNION ALL SELECT repo, 'svc/v2_' || k || '.py', 'renamed', 'app/part_' || k || '.py', 0.75::DOUBLE FROM p WHERE fate = 'edited'
UNION ALL SELECT repo, 'svc/part_' || k || '.py', 'added', NULL, NULL FROM p WHERE fate IN ('new', 'replaced')"""
ORACLE["prov_added_date"] = _with(
    _HISTORY, _FILES,
    select="SELECT repo, 'svc/api/part_' || p || '.py' AS path FROM born JOIN since_date USING (k)",
)
ORACLE["prov_annotate"] = _with(
    _HISTORY, _FILES,
    select=f"""SELECT 'h' || (p_partkey % 3) AS repo, 'api/part_' || p_partkey || '.py' AS source_file,
  {_at_line('p_partkey', 'g.line')} AS line_number,
  s.k IS NOT NULL AS is_new, CASE WHEN s.k IS NULL THEN NULL WHEN p_size > 30 THEN 'added' ELSE 'modified' END
    AS change_type,
  substr(s.sha, 1, 10) AS commit, s.author, strftime(s.made, '%Y-%m-%dT%H:%M:%S+00:00') AS committed_at
FROM part CROSS JOIN range(0, 8) AS g(line)
LEFT JOIN blamed b ON b.p = p_partkey AND b.line = g.line LEFT JOIN since_ref s ON s.k = b.k""",
)
_NEW = """fresh AS (
  SELECT s.repo, b.p, b.line, s.author, CASE WHEN w.k IS NULL THEN 'modified' ELSE 'added' END AS change_type
  FROM blamed b JOIN since_date s ON s.k = b.k JOIN born ON born.p = b.p LEFT JOIN since_date w ON w.k = born.k)"""
ORACLE["new_unauth"] = _with(
    _HISTORY, _FILES, _NEW,
    select="SELECT repo, count(*) AS new_unauthenticated_count FROM fresh WHERE line % 2 = 1 GROUP BY repo",
)
ORACLE["new_list"] = _with(
    _HISTORY, _FILES, _NEW,
    select=f"SELECT repo, 'api/part_' || p || '.py' AS source_file, {_at_line('p', 'line')} AS line_number, 'GET' AS method, "
    "'/x/' || line AS path, line % 2 = 0 AS auth_required, change_type, author FROM fresh",
)
ORACLE["blame_parse"] = _with(
    _HISTORY, _FILES,
    select="SELECT repo, 'svc/api/part_' || p || '.py' AS path, line, substr(sha, 1, 10) AS commit, author, "
    "strftime(made, '%Y-%m-%dT%H:%M:%S+00:00') AS committed_at FROM blamed JOIN log USING (k)",
)

# --- redaction --------------------------------------------------------------------


def _redacted(text: str) -> str:
    word = "[\\p{L}\\p{N}_]"
    jwt = "\\bey[A-Za-z0-9\\-_=]+\\.ey[A-Za-z0-9\\-_=]+\\.[A-Za-z0-9\\-_.+/=]*\\b"
    secret = (
        f"(?i)(\\b{word}*(?:api_key|secret|password|passwd|token|private_key|credential){word}*\\b\\s*[:=]\\s*"
        "[''\"])([^''\"]{4,})([''\"])"
    )
    mail = "\\b[a-zA-Z0-9_.+\\-]+@[a-zA-Z0-9\\-]+\\.[a-zA-Z0-9\\-.]+\\b"
    once = f"regexp_replace({text}, '{jwt}', '[REDACTED_JWT]', 'g')"
    twice = f"regexp_replace({once}, '{secret}', '\\1[REDACTED_SECRET]\\3', 'g')"
    return f"regexp_replace({twice}, '{mail}', '[REDACTED_EMAIL]', 'g')"


def _clean_tail(key: str) -> str:
    """What must be left of the planted text: the echoed key is replaced as well."""
    return (
        f"""(CASE ({key}) % 4 WHEN 0 THEN ' api_key = "[REDACTED_SECRET]" ' WHEN 1 THEN ' [REDACTED_JWT]! '
  WHEN 2 THEN ' My_[REDACTED_SECRET]: ''[REDACTED_SECRET]'' [REDACTED_EMAIL] ' ELSE '' END)"""
    )


ORACLE["redact_documents"] = (
    f"SELECT doc_id, {_redacted('text')} || {_clean_tail('doc_id')} AS text FROM documents"
)
ORACLE["redact_pages"] = f"SELECT page_id, url, {_redacted('html')} AS html FROM pages"
ORACLE["redact_nested"] = (
    f"SELECT conv_id, turn, role, {_redacted('text')} || {_clean_tail('conv_id + turn')} AS text FROM conversations"
)

# --- reports ----------------------------------------------------------------------

_FINDINGS = """findings AS (
  SELECT *, 'shadow-endpoint' AS rule_id,
    'Shadow endpoint ' || method || ' ' || path || ' is not present in the OpenAPI registry.' AS message
  FROM matches WHERE status = 'shadow'
  UNION ALL
  SELECT *, 'missing-auth',
    'Endpoint ' || method || ' ' || path || ' has no detected authentication/authorization control.'
  FROM matches WHERE NOT auth_required)"""
ORACLE["sarif_results"] = _with(
    *_COMPARED, _FINDINGS,
    select="SELECT repo, rule_id, 'error' AS level, message, replace(source_file, '\\', '/') AS uri, "
    "greatest(1, line_number) AS start_line, method, path, framework, language, is_new FROM findings",
)
ORACLE["sarif_doc"] = _with(
    *_COMPARED, _FINDINGS, "repos AS (SELECT repo FROM observed UNION SELECT repo FROM reg)",
    select="""SELECT repo, 1 AS documents, '2.1.0' AS version, 'shadow-endpoint,missing-auth' AS rules,
  NULL AS leads, NULL AS rule_id, NULL AS message, NULL AS uri, NULL AS start_line, NULL AS method, NULL AS path
FROM repos
UNION ALL SELECT repo, NULL, NULL, NULL,
  row_number() OVER (PARTITION BY repo ORDER BY rule_id DESC, source_file, line_number, path, method) = 1,
  rule_id, message, replace(source_file, '\\', '/'), greatest(1, line_number), method, path
FROM findings""",
)
ORACLE["sarif_written"] = _with(
    *_COMPARED, _FINDINGS, "repos AS (SELECT repo FROM observed UNION SELECT repo FROM reg)",
    select="""SELECT repo, count(rule_id) + 2 AS n_lines, 1 AS documents,
  greatest(count(rule_id) - 1, 0) AS followers
FROM repos LEFT JOIN findings USING (repo) GROUP BY repo""",
)
ORACLE["batch_written"] = _with(
    _JS,
    select="""SELECT repo, count(*) AS n_endpoints, count(*) + count(*) FILTER (WHERE NOT auth_required) AS n_findings,
  count(*) + count(*) FILTER (WHERE NOT auth_required) + 2 AS n_sarif_lines,
  count(*) + count(*) FILTER (WHERE NOT auth_required) AS violations, false AS passed FROM js GROUP BY repo""",
)
ORACLE["append_twice"] = _with(
    _OBSERVED,
    select="SELECT repo, path, method, source_file, line_number, framework, auth_required FROM observed",
)
ORACLE["report_json"] = _with(
    *_COMPARED, _POSTURE,
    """listed AS (
  SELECT *, 'shadow' AS list FROM matches WHERE status = 'shadow'
  UNION ALL SELECT *, 'missing_auth' FROM matches WHERE NOT auth_required
  UNION ALL SELECT *, 'new' FROM matches WHERE is_new)""",
    select="""SELECT repo, parsed_routes_count, registered_routes_count, coverage_ratio, NULL AS list, NULL AS leads,
  NULL AS path, NULL AS method, NULL AS auth_required, NULL AS auth_info, NULL AS source_file, NULL AS line_number,
  NULL AS is_new, NULL AS commit, NULL AS author, NULL AS committed_at
FROM posture
UNION ALL SELECT repo, NULL, NULL, NULL, list,
  row_number() OVER (PARTITION BY repo, list ORDER BY source_file, line_number, path, method) = 1,
  path, method, auth_required, NULL, source_file, line_number, is_new,
  CASE WHEN is_new THEN 'c0ffee1' END, CASE WHEN is_new THEN 'A "quoted" name' END,
  CASE WHEN is_new THEN strftime(make_timestamp((1000000000 + line_number)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' END
FROM listed""",
)

# --- remediation ------------------------------------------------------------------

_GUARD = ", dependencies=[Depends(verify_token)])"
_EDITS = f"""flagged AS (
  SELECT repo, path, method, framework, caller, what, k, size,
    CASE WHEN source_file LIKE '%7.py' THEN source_file || '.gone' ELSE source_file END AS source_file,
    CASE WHEN source_file LIKE '%3.py' THEN line_number + 1000 ELSE line_number END AS line_number,
    CASE WHEN source_file LIKE '%7.py' THEN 'generic' WHEN source_file LIKE '%3.py' THEN 'out_of_bounds'
         ELSE 'edit' END AS status,
    CASE k % 3 WHEN 0 THEN size % 4 = 1 OR size % 3 <> 0 WHEN 1 THEN size % 4 = 0 OR size % 3 <> 0 END AS imported
  FROM py WHERE NOT auth_required),
edits AS (
  SELECT *, 0 AS seq, 'insert_before' AS op, 1 AS at_line, NULL AS old,
    CASE framework WHEN 'Flask' THEN 'from flask_jwt_extended import jwt_required'
      ELSE 'from fastapi import Depends' END AS new
  FROM flagged WHERE status = 'edit' AND NOT coalesce(imported, false)
  UNION ALL
  SELECT * EXCLUDE (at_line, old), CASE WHEN imported THEN 0 ELSE 1 END, 'replace', at_line, old || ')', old || '{_GUARD}'
  FROM (
    SELECT *, CASE what WHEN 'close' THEN 16 WHEN 'rota' THEN 7 ELSE 11 END AS at_line,
      '@' || caller || CASE what WHEN 'close' THEN '.delete("/valves/{{valve}}"'
        WHEN 'rota' THEN '.api_route(path="/rota/", methods=["get", "Head"]' ELSE '.get("/rota/{{day}}/"' END AS old
    FROM flagged
    WHERE status = 'edit' AND (what = 'day' OR what IN ('close', 'rota') AND size % 3 = 0))
  UNION ALL
  SELECT *, 1, 'insert_after', CASE what WHEN 'soil' THEN 7 ELSE 13 END, NULL, '@jwt_required()'
  FROM flagged WHERE status = 'edit' AND framework = 'Flask')"""
_FLAGGED_KEY = "repo, source_file, line_number, method, path"
ORACLE["remedy_edits"] = _with(
    _PY,
    _EDITS,
    select=f"""SELECT {_FLAGGED_KEY}, framework, status, seq, op, at_line, old, new FROM edits
UNION ALL SELECT {_FLAGGED_KEY}, framework, status, NULL, NULL, NULL, NULL, NULL
FROM flagged ANTI JOIN edits USING ({_FLAGGED_KEY})""",
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _python_lines() -> str:
    """The lines of every module, as the derived input has them."""
    shapes = ", ".join(_text(t) for t in (PYTHON_VALVES, PYTHON_ROTA, PYTHON_PLOTS))
    filled = f"([{shapes}])[k % 3 + 1]"
    for name, options, every in (
        ("param", PARAMS, 4), ("named", NAMED, 4), ("deps", PYTHON_DEPENDENCIES, 3), ("guard", PYTHON_GUARDS, 2),
    ):
        listed = ", ".join(_text(o) for o in options)
        filled = f"replace({filled}, '%{name}%', ([{listed}])[size % {every} + 1])"
    for name, value in (("v", "CAST(k % 5 AS VARCHAR)"), ("kind", "kind[2:]"), ("k", "CAST(k AS VARCHAR)")):
        filled = f"replace({filled}, '%{name}%', {value})"
    return f"""files AS (SELECT repo, source_file, string_split(rtrim({filled}, chr(10)), chr(10)) AS body FROM modules),
file_lines AS (
  SELECT repo, source_file, unnest(body) AS text, generate_subscripts(body, 1) AS n, len(body) AS n_lines FROM files)"""


# Old lines near a change are kept; those in a row form a hunk; both sides are counted.
ORACLE["remedy_diff"] = _with(
    _PY,
    _EDITS,
    _python_lines(),
    f"""near AS (
  SELECT DISTINCT e.repo, e.source_file, e.line_number, e.method, e.path, l.n, l.text
  FROM edits e JOIN file_lines l ON l.repo = e.repo AND l.source_file = e.source_file
    AND l.n BETWEEN e.at_line - CASE op WHEN 'insert_after' THEN 2 ELSE 3 END
      AND e.at_line + CASE op WHEN 'insert_before' THEN 2 ELSE 3 END),
islands AS (
  SELECT *, n - row_number() OVER (PARTITION BY {_FLAGGED_KEY} ORDER BY n) AS hunk FROM near),
diff_lines AS (
  SELECT {_FLAGGED_KEY}, hunk, n, CASE WHEN r.old IS NULL THEN 1 ELSE 0 END AS slot,
    CASE WHEN r.old IS NULL THEN ' ' ELSE '-' END || text AS line, 1 AS olds, CASE WHEN r.old IS NULL THEN 1 ELSE 0 END AS news
  FROM islands LEFT JOIN (SELECT {_FLAGGED_KEY}, at_line AS n, old FROM edits WHERE op = 'replace') r
    USING ({_FLAGGED_KEY}, n)
  UNION ALL
  SELECT {_FLAGGED_KEY}, hunk, n, CASE op WHEN 'insert_before' THEN 0.5 ELSE 2 END, '+' || new, 0, 1
  FROM islands JOIN (SELECT {_FLAGGED_KEY}, at_line AS n, op, new FROM edits) e USING ({_FLAGGED_KEY}, n)),
sums AS (
  SELECT {_FLAGGED_KEY}, hunk, min(n) AS first, sum(olds) AS olds, sum(news) AS news
  FROM diff_lines GROUP BY {_FLAGGED_KEY}, hunk),
counted AS (
  SELECT *, coalesce(sum(news - olds) OVER (PARTITION BY {_FLAGGED_KEY} ORDER BY hunk
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM sums),
parts AS (
  SELECT {_FLAGGED_KEY}, hunk, n, slot, line FROM diff_lines
  UNION ALL
  SELECT {_FLAGGED_KEY}, hunk, 0, 0, '@@ -' || first || CASE olds WHEN 1 THEN '' ELSE ',' || olds END
    || ' +' || (first + moved) || CASE news WHEN 1 THEN '' ELSE ',' || news END || ' @@' FROM counted
  UNION ALL
  SELECT DISTINCT {_FLAGGED_KEY}, -1000000, v.n, 0, v.sign || source_file
  FROM edits, (VALUES (1, '--- a/'), (2, '+++ b/')) v(n, sign)),
others AS (
  SELECT {_FLAGGED_KEY}, status, CASE status
    WHEN 'generic' THEN ['--- a/' || source_file, '+++ b/' || source_file,
      '@@ -' || line_number || ',3 +' || line_number || ',4 @@',
      '# Generic Remediation Patch for ' || framework || ' Endpoint', '# Target: ' || method || ' ' || path,
      '# Action: Inject authentication token validation controls.']
    WHEN 'out_of_bounds' THEN ['# Error: Line number ' || line_number || ' is out of bounds for ' || source_file]
    ELSE [NULL] END AS body
  FROM flagged ANTI JOIN edits USING ({_FLAGGED_KEY}))""",
    select=f"""SELECT {_FLAGGED_KEY}, 'edit' AS status,
  row_number() OVER (PARTITION BY {_FLAGGED_KEY} ORDER BY hunk, n, slot) - 1 AS at, line FROM parts
UNION ALL SELECT {_FLAGGED_KEY}, status, generate_subscripts(body, 1) - 1, unnest(body) FROM others""",
)
