"""The catalogue's queries as DuckDB SQL over the same tables, written from the specification, for comparison."""

from __future__ import annotations

from skeinwork.operators import answers as A
from skeinwork.operators import relations as R
from skeinwork.operators.entities import FIELDS
from skeinwork.plans import fixed as S
from skeinwork.sources import fixtures as fx

_TYPES = {"string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(words) -> str:
    return ", ".join(map(_text, words))


def _values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(v) if isinstance(v, int) else _text(v) for v in r) + ')' for r in rows)}) v({names}))"


def _pack(fields: dict, given: dict) -> str:
    return "struct_pack(" + ", ".join(f'"{k}" := CAST({given.get(k, "NULL")} AS {_TYPES[v]})' for k, v in fields.items()) + ")"


def _ent(text: str, kind: str, confidence: float, **more) -> str:
    return _pack(FIELDS, {"text": text, "type": kind, "confidence": str(confidence), **more})


def _rel(source: str, target: str, kind: str, confidence: float, **more) -> str:
    return _pack(R.FIELDS, {"source": source, "target": target, "type": kind, "confidence": str(confidence), **more})


def _if(condition: str, item: str) -> str:
    return f"CASE WHEN {condition} THEN [{item}] ELSE [] END"


def _full(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def _concat(parts: list[str]) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def _each(name: str, table: str, items: str) -> str:
    """CTEs that give each item of a row with its order."""
    return f"""{name}_l AS (SELECT chunk_id, source_doc, ord, {items} AS items FROM {table}),
      {name}_i AS (SELECT chunk_id, source_doc, ord, items, unnest(range(1, len(items) + 1)) AS i FROM {name}_l),
      {name}_x AS (SELECT chunk_id, source_doc, ord || '/' || lpad(CAST(i - 1 AS VARCHAR), 8, '0') AS ord, items[i] AS x FROM {name}_i),
      {name} AS (SELECT chunk_id, source_doc, ord, unnest(x) FROM {name}_x)"""


def _classify(t: str, source: bool) -> str:
    return f"""CASE WHEN {" OR ".join(f"contains({t}, {_text(m)})" for m in S.COMPANY_MARKS)} THEN 'ORGANIZATION'
      WHEN regexp_matches({t}, '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?$') THEN '{"ORGANIZATION" if source else "PRODUCT"}'
      WHEN {t} = upper({t}) AND {t} <> lower({t}) AND length({t}) <= 5 THEN 'TECHNOLOGY' WHEN {t} IN ({_words(S.PLACES)}) THEN 'LOCATION'
      WHEN {" OR ".join(f"contains(lower({t}), {_text(m)})" for m in S.DEPARTMENT_MARKS)} THEN 'DEPARTMENT' ELSE 'ENTITY' END"""


_TARGET = f"CASE WHEN lower(target_type) = 'entity' THEN {_classify('target', False)} WHEN lower(target_type) = 'concept' THEN 'CONCEPT' WHEN lower(target_type) = 'data' THEN 'METRIC' ELSE 'ENTITY' END"
_ER = f"er AS (SELECT 'er_' || ord AS chunk_id, 'er.csv' AS source_doc, * FROM ({fx.duck(fx.ER_ROWS)}) r)"
_SS = f"ss AS (SELECT 'ss_' || ord AS chunk_id, 'ss.csv' AS source_doc, * FROM ({fx.duck(fx.SS_ROWS)}) r)"
# letters outside ASCII are word characters for the specification: an underscore stands for them, so that word boundaries agree
_CHUNKS = f"chunks AS (SELECT *, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS ascii FROM ({fx.duck(fx.TEXT_CHUNKS)}) c)"
_CAPITALISED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_URL = r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_\+.~#?&/=]*"
_NUMBER = r"\b\d+(?:\.\d+)?\b"
_BRAND = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"
_NOTE = {"column": "'evidence_note'", "is_key": "false", "derived_from": "'evidence'", "section": "section", "year": "year"}


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {_text(pattern)})"


def _evidence() -> str:
    note = "coalesce(evidence_note, '')"
    brands = _all(note, _BRAND)
    return _concat([
        f"list_transform(list_filter({brands}, lambda b, i: list_position({brands}, b) = i AND length(b) > 2), lambda t: {_ent('t', _text('BRAND'), 0.7, **_NOTE)})",
        f"list_transform({_all(note, r'~?\d+(?:\.\d+)?%')}, lambda t: {_ent('t', _text('PERCENTAGE'), 1.0, **_NOTE)})",
        f"list_transform({_all(note, r'#\d+')}, lambda t: {_ent('t', _text('RANK'), 1.0, **_NOTE)})",
    ])


_VALUE = "try_cast(value AS DOUBLE)"
_HERE = {"section": "section", "year": "year"}
_ENT = _each("ent", "er", _concat([
    _if(_full("source"), _ent("source", _classify("source", True), 1.0, column="'source'", is_key="true", relation="relation", **_HERE)),
    _if(_full("target"), _ent("target", _TARGET, 1.0, column="'target'", is_key="true", relation="relation", entity_category="target_type", **_HERE)),
    _if(_full("section"), _ent("section", "'SECTION'", 0.9, column="'section'", is_key="false", year="year")),
    _if(_full("year"), _ent("replace(year, '.0', '')", "'YEAR'", 1.0, column="'year'", is_key="false")),
    _if(f"{_full('value')} AND {_VALUE} IS NOT NULL", _ent(f"CASE WHEN {_full('unit')} THEN CAST({_VALUE} AS VARCHAR) || ' ' || unit ELSE CAST({_VALUE} AS VARCHAR) END", "'METRIC'", 1.0, column="'value'", is_key="false", value=_VALUE, unit="unit", **_HERE)),
    _evidence(),
]))
_PRIMARY = "(is_key OR \"column\" IS NULL OR \"column\" <> 'evidence_note')"
_DEDUP = """own_g AS (SELECT arg_min(e, ord) AS e, max(confidence) AS confidence FROM (SELECT e, e.type AS type, e.text AS text, e.ord AS ord, e.confidence AS confidence FROM (SELECT ent AS e FROM ent)) GROUP BY type, trim(lower(text))),
  own AS (SELECT unnest(e) FROM (SELECT struct_pack(ord := e.ord, chunk_id := e.chunk_id, source := e.source_doc, text := e.text, type := e.type, "column" := e."column", is_key := e.is_key, confidence := confidence,
    section := e.section, year := e.year, relation := e.relation, entity_category := e.entity_category, value := e.value, unit := e.unit, derived_from := e.derived_from) AS e FROM own_g))"""
_FILLED = lambda n: f"({_full(n)} AND trim({n}) <> '')"
_YEAR = "replace(coalesce(year, ''), '.0', '')"
_REL = f"""kinds AS (SELECT text, arg_min(type, ord) AS kind FROM own GROUP BY text),
  wide AS (SELECT er.*, s.kind AS source_kind, t.kind AS target_kind FROM er LEFT JOIN kinds s ON s.text = er.source LEFT JOIN kinds t ON t.text = er.target),
  """ + _each("rel", "wide", _concat([
    _if(f"{_full('source')} AND {_full('relation')} AND {_full('target')}", _rel("source", "target", "replace(upper(relation), ' ', '_')", 1.0, year=_YEAR, section="section", source_type="source_kind", target_type="coalesce(target_kind, target_type)",
        value=f"CASE WHEN {_FILLED('value')} THEN value END", unit=f"CASE WHEN {_FILLED('value')} AND {_FILLED('unit')} THEN unit END", evidence=f"CASE WHEN {_FILLED('evidence_note')} THEN evidence_note END")),
    _if(f"{_full('source')} AND {_full('section')}", _rel("source", "section", "'IN_SECTION'", 0.9, year=_YEAR)),
    _if(f"{_full('source')} AND {_YEAR} <> ''", _rel("source", _YEAR, "'IN_YEAR'", 1.0)),
]))
_RELDEDUP = """red AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY trim(lower(source)), trim(lower(target)), type ORDER BY confidence DESC, ord) AS n FROM rel) WHERE n = 1)"""
_NODES = f"""nodes AS (SELECT text AS node_id, e.type AS node_type, text AS name, e.confidence AS confidence, e.chunk_id AS chunk_id, e."column" AS "column", e.is_key AS is_key, e.section AS section, e.year AS year, e.value AS value, e.unit AS unit
  FROM (SELECT text, arg_max(p, ord) AS e FROM (SELECT p, p.text AS text, p.ord AS ord FROM (SELECT own AS p FROM own WHERE {_PRIMARY})) GROUP BY text))"""
_EDGES = "edges AS (SELECT ord AS edge_id, source, target, type, confidence, year, section, value, unit, evidence, ord FROM red WHERE source IS NOT NULL AND target IS NOT NULL)"
_GRAPH = ", ".join([_ER, _ENT, _DEDUP, _REL, _RELDEDUP, _NODES, _EDGES])
_OUT = 'chunk_id, text, type, "column", is_key, confidence, section, year, relation, entity_category, round(value, 6) AS value, unit, derived_from'


def _keyword() -> str:
    """CTE ent over the text chunks, with offsets: what stands between matches and in the matches before."""

    def spans(source: str, pattern: str, kind: str, confidence: float, keep: str = "true") -> str:
        hits = f"regexp_extract_all({source}, {_text(pattern)})"
        gaps = f"regexp_split_to_array({source}, {_text(pattern)})"
        return f"""SELECT chunk_id, source_doc, ord, text AS body, h[i] AS text, '{kind}' AS type, {confidence} AS confidence, i, '{kind}' AS k,
          CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(h[1:i-1], lambda z: length(z))), 0) AS BIGINT) AS "start"
          FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT *, {hits} AS h, {gaps} AS g FROM chunks)) WHERE {keep}"""

    stop = f"length(h[i]) BETWEEN 2 AND 50 AND lower(h[i]) NOT IN ({_words(S.STOP_WORDS)})"
    parts = [spans("ascii", _CAPITALISED, "NAMED_ENTITY", 0.7, stop), spans("text", _EMAIL, "EMAIL", 1.0), spans("text", _URL, "URL", 1.0), spans("ascii", _NUMBER, "NUMBER", 1.0)]
    return f"""{_CHUNKS}, found AS ({" UNION ALL ".join(parts)}),
      ent AS (SELECT *, "start" + length(text) AS "end", CASE k WHEN 'NAMED_ENTITY' THEN 0 WHEN 'EMAIL' THEN 1 WHEN 'URL' THEN 2 ELSE 3 END AS rank FROM found)"""


_KEYWORD = _keyword()
_NODE_VECTORS = f"nv AS ({fx.duck(fx.NODE_VECTORS)})"
_EDGE_VECTORS = f"ev AS ({fx.duck(fx.EDGE_VECTORS)})"
_ASKED = f"q AS ({fx.duck(fx.VECTOR_QUESTIONS)})"
_L2 = "list_sum(list_transform(list_zip(v.embedding, q.query), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))"


def _near(name: str, table: str, columns: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM
      (SELECT q.query_id, q.question, q.node_type_filter, q.name1, q.name2, q.year1, v.vec_id, {columns}, {_L2} AS distance FROM {table} v, q))"""


_VEC = f"WITH {_NODE_VECTORS}, {_ASKED}, {_near('near', 'nv', 'v.node_type, v.entity_name')}"
_VEC2 = f"{_VEC}, {_EDGE_VECTORS}, {_near('enear', 'ev', 'v.source, v.target, v.relationship_type, v.year, v.section')}"
_HIT = "query_id, rank, vec_id, node_type, round(distance, 6) AS distance"
_FILTERED = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, node_type, entity_name, distance FROM near WHERE rank <= 20 AND "
_BOOST = "(CASE WHEN node_type = node_type_filter THEN 1.5 ELSE 1.0 END * CASE WHEN entity_name IN (name1, name2) THEN 2.0 ELSE 1.0 END)"
_EBOOST = "CASE WHEN contains(year, year1) THEN 1.3 ELSE 1.0 END"


def _rerank(base: str, boost: str, table: str, k: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, input_rank) AS rank FROM
      (SELECT * EXCLUDE (rank), rank AS input_rank, {boost} AS boost, least({base} * {boost}, 1.0) AS final_score FROM {table} WHERE rank <= {k})"""


_HYBRID = f"{_VEC2}, hn AS ({_rerank('distance', _BOOST, 'near', 10)}), he AS ({_rerank('distance', _EBOOST, 'enear', 10)})"
_VECTOR = f"""{_VEC2}, vn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, node_type, entity_name, distance FROM near
  WHERE rank <= 20 AND (node_type_filter IS NULL OR node_type = node_type_filter)), ve AS (SELECT * FROM enear WHERE rank <= 10)"""
# letters outside ASCII as in _CHUNKS, here without punctuation
_QUESTIONS = f"q AS (SELECT *, regexp_replace(question, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}]', '_', 'g') AS ascii FROM ({fx.duck(fx.ASKED)}) a)"


def _intent() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(ascii), {_text('|'.join(p))}) THEN '{n}'" for n, p in S.INTENTS)
    return f"CASE {cases} ELSE 'exploration' END"


_INTENT = _intent()
_Q_ENTITIES = _concat([_all("ascii", _CAPITALISED), "regexp_extract_all(question, '\"([^\"]*)\"', 1)", r"regexp_extract_all(ascii, '\b(20\d{2})\b', 1)"])
_Q_TEMPORAL = rf"list_concat(regexp_extract_all(ascii, '\b(20\d{{2}})\b', 1), regexp_extract_all(lower(ascii), {_text(S.TIMES)}, 1))"
_Q_KEYWORDS = rf"list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: length(x) > 2 AND x NOT IN ({_words(S.QUESTION_STOP_WORDS)}))"
_NODE_TYPE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(question), {_text(w)})' for w in ws)} THEN '{n}'" for n, ws in reversed(S.TYPE_WORDS)) + " END"


def _unrolled(items: str, name: str) -> str:
    return f"WITH {_QUESTIONS}, l AS (SELECT query_id, {items} AS items FROM q) SELECT query_id, i - 1 AS at, items[i] AS {name} FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM l)"


def _trails(edges: str, seeds: str, depth: int) -> str:
    """CTE trail: undirected paths over different edges."""
    return f"""step AS (SELECT source AS a, target AS b, edge_id FROM {edges} UNION ALL SELECT target, source, edge_id FROM {edges} WHERE source <> target),
      trail AS (SELECT seed, seed AS node, CAST([] AS VARCHAR[]) AS path, 0 AS length FROM {seeds}
        UNION ALL SELECT t.seed, s.b, list_append(t.path, s.edge_id), t.length + 1 FROM trail t JOIN step s ON s.a = t.node WHERE t.length < {depth} AND NOT list_contains(t.path, s.edge_id))"""


def _related(names: list[str], depth: int) -> str:
    return f"""WITH RECURSIVE {_GRAPH}, g AS MATERIALIZED (SELECT edge_id, source, target FROM edges), s AS {_values([(n,) for n in names], "seed")}, {_trails("g", "s", depth)}
      SELECT * FROM (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY length, array_to_string(path, chr(31)), node) AS path_rank, node, length, path[1] AS first_edge FROM trail WHERE length > 0) WHERE path_rank <= 12"""


def _hops(seeds: str, depth: int) -> str:
    return f"""seeds AS {seeds}, link AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
      walk AS (SELECT seed, seed AS node, 0 AS d FROM seeds UNION SELECT w.seed, l.b, w.d + 1 FROM walk w JOIN link l ON l.a = w.node WHERE w.d < {depth}),
      reach AS (SELECT seed, node, min(d) AS distance FROM walk GROUP BY ALL)"""


_NAMED_QUESTIONS = f"""qe AS (SELECT query_id, question, list_filter({_Q_ENTITIES}, lambda x, i: list_position({_Q_ENTITIES}, x) = i) AS ents FROM (SELECT *, question AS ascii FROM {_values(fx.QUESTIONS, 'query_id, question')} v) q),
  asked AS (SELECT query_id, i - 1 AS nth, ents[i] AS seed FROM (SELECT *, unnest(range(1, least(len(ents), 3) + 1)) AS i FROM qe)),
  own_seeds AS (SELECT * FROM asked WHERE seed IN (SELECT name FROM nodes))"""
_BY_GRAPH = f"""WITH RECURSIVE {_GRAPH}, {_NAMED_QUESTIONS}, {_trails("edges", "(SELECT DISTINCT seed FROM own_seeds) s", 2)},
  ranked AS (SELECT seed, node, path[1] AS first, row_number() OVER (PARTITION BY seed ORDER BY length, array_to_string(path, chr(31)), node) AS path_rank FROM trail WHERE length > 0),
  found AS (SELECT o.query_id, o.nth, r.* FROM own_seeds o JOIN ranked r ON r.seed = o.seed WHERE path_rank <= 10),
  hits AS (SELECT query_id, nth, 0 AS pr, seed AS name, 1.0 AS score FROM own_seeds UNION ALL SELECT query_id, nth, min(path_rank), node, 0.8 FROM found GROUP BY query_id, nth, node),
  merged AS (SELECT query_id, name, min((nth, pr)) AS place, arg_max(score, (nth, pr)) AS score FROM hits GROUP BY ALL),
  gn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, name) AS rank FROM merged) WHERE rank <= 10),
  firsts AS (SELECT query_id, nth, first, min(path_rank) AS pr FROM found GROUP BY ALL),
  ge AS (SELECT * FROM (SELECT f.query_id, e.*, row_number() OVER (PARTITION BY f.query_id ORDER BY f.nth, f.pr, f.first) AS rank FROM firsts f JOIN edges e ON e.edge_id = f.first) WHERE rank <= 10)"""


def _graph_context() -> str:
    return f"""{_BY_GRAPH},
      en AS (SELECT g.query_id, g.rank, g.name, n.section, n.year FROM gn g LEFT JOIN nodes n ON n.name = g.name),
      conn AS (SELECT *, row_number() OVER (PARTITION BY query_id, e_rank ORDER BY r_rank) AS nth FROM
        (SELECT e.query_id, e.rank AS e_rank, r.rank AS r_rank, CASE WHEN r.source = e.name THEN '   - RELATED_TO → ' || r.target ELSE '   - ' || r.source || ' → RELATED_TO' END AS line
         FROM en e JOIN ge r ON r.query_id = e.query_id AND (r.source = e.name OR r.target = e.name) WHERE e.rank <= 10)),
      links AS (SELECT query_id, e_rank, string_agg(line, '' ORDER BY nth) AS links FROM conn WHERE nth <= 5 GROUP BY ALL),
      lines AS (SELECT e.query_id, string_agg(chr(10) || e.rank || '. ' || e.name || ' (ENTITY)' || coalesce('   Connections:' || links, '') || coalesce('   From: ' || section, '') || coalesce('   Year: ' || year, ''), '' ORDER BY e.rank) AS body
        FROM en e LEFT JOIN links l ON l.query_id = e.query_id AND l.e_rank = e.rank WHERE e.rank <= 10 GROUP BY ALL),
      ctx AS (SELECT CAST(q.query_id AS VARCHAR) AS query_id, 'Query: ' || q.question || chr(10) || {_text(S.HEAD["graph"])} || coalesce(body, '') AS context_text,
        (SELECT count(*) FROM gn WHERE gn.query_id = q.query_id) AS entity_count, (SELECT count(*) FROM ge WHERE ge.query_id = q.query_id) AS relationship_count FROM qe q LEFT JOIN lines l ON l.query_id = q.query_id)
      SELECT *, length(context_text) // 4 AS token_count FROM ctx"""


def _listed(table: str, line: str, most: int) -> str:
    return f"SELECT query_id, string_agg({line}, '' ORDER BY rank) AS body, count(*) AS n FROM {table} WHERE rank <= {most} GROUP BY ALL"


def _vector_context(final: str) -> str:
    shown = "' [Relevance: ' || printf('%.3f', distance) || ']'"
    return f"""{_VECTOR},
      e AS ({_listed("vn", f"chr(10) || rank || '. ' || entity_name || ' (' || node_type || ')' || {shown}", 10)}),
      r AS ({_listed("ve", f"chr(10) || rank || '. ' || source || ' --[' || relationship_type || ']--> ' || target || {shown}", 10)}),
      ctx AS (SELECT CAST(q.query_id AS VARCHAR) AS query_id, q.question,
        'Query: ' || q.question || chr(10) || {_text(S.HEAD["vector"])} || coalesce(e.body, '') || coalesce({_text(S.EDGE_HEAD["vector"])} || r.body, '') AS context_text,
        coalesce(e.n, 0) AS ne, coalesce(r.n, 0) AS nr
        FROM q LEFT JOIN e ON e.query_id = q.query_id LEFT JOIN r ON r.query_id = q.query_id),
      src AS (SELECT CAST(query_id AS VARCHAR) AS query_id, count(DISTINCT section) AS n_sources FROM ve GROUP BY query_id)
      {final}"""


_CONFIDENCE = """round(least(0.5 + CASE WHEN ne > 5 THEN 0.2 WHEN ne > 2 THEN 0.1 ELSE 0 END + CASE WHEN nr > 5 THEN 0.2 WHEN nr > 2 THEN 0.1 ELSE 0 END, 0.95), 6)::DOUBLE"""


def _prompt(parts: tuple[str, str, str]) -> str:
    return f"{_text(parts[0])} || context_text || {_text(parts[1])} || question || {_text(parts[2])}"


def _hybrid_context(final: str) -> str:
    """The hybrid layout with what is around the five best names, and the sources of its edges."""
    shown = "' [Relevance: ' || printf('%.3f', final_score)"
    node = f"chr(10) || rank || '. ' || entity_name || ' (' || node_type || ')' || {shown} || ', Boost: ' || printf('%.2f', boost) || ']'"
    edge = f"chr(10) || rank || '. ' || source || ' --[' || relationship_type || ']--> ' || target || {shown} || ']' || '   From: ' || section"
    return f"""{_HYBRID.replace("WITH", "WITH RECURSIVE", 1)},
      ed AS (SELECT source, target, relationship_type AS type, 'v' || lpad(CAST(vec_id AS VARCHAR), 12, '0') AS edge_id FROM ev),
      own AS (SELECT query_id, rank AS nth, entity_name AS seed FROM hn WHERE rank <= 5), {_trails("ed", "(SELECT DISTINCT seed FROM own) s", 2)},
      tr AS (SELECT * FROM (SELECT seed, node, path[1] AS first, row_number() OVER (PARTITION BY seed ORDER BY length, array_to_string(path, chr(31)), node) AS n FROM trail WHERE length > 0) WHERE n <= 50),
      sub AS (SELECT query_id, list_sort(list(DISTINCT node)) AS nodes, count(DISTINCT (nth, first)) AS edge_count FROM own JOIN tr ON tr.seed = own.seed GROUP BY query_id),
      e AS ({_listed("hn", node, 8)}), r AS ({_listed("he", edge, 8)}),
      src AS (SELECT query_id, string_agg(DISTINCT 'Section: ' || section, ';' ORDER BY 'Section: ' || section) AS sources FROM he GROUP BY query_id),
      ctx AS (SELECT CAST(q.query_id AS VARCHAR) AS query_id, q.question,
        'Query: ' || q.question || chr(10) || {_text(S.HEAD["hybrid"])} || coalesce(e.body, '') || coalesce({_text(S.EDGE_HEAD["hybrid"])} || r.body, '')
        || coalesce(chr(10) || chr(10) || '--- Connected Graph Neighborhood ---' || chr(10) || '  Total connected entities: ' || len(sub.nodes) || '  Total relationships: ' || edge_count
          || chr(10) || '  Connected entities: ' || array_to_string(sub.nodes[1:10], ', '), '') AS context_text,
        (SELECT count(*) FROM hn WHERE hn.query_id = q.query_id) AS ne, (SELECT count(*) FROM he WHERE he.query_id = q.query_id) AS nr, coalesce(sources, '') AS sources
        FROM q LEFT JOIN e ON e.query_id = q.query_id LEFT JOIN r ON r.query_id = q.query_id LEFT JOIN sub ON sub.query_id = q.query_id LEFT JOIN src ON src.query_id = q.query_id)
      {final}"""


def _windows(source: str, name: str, size: int, overlap: int) -> str:
    """Recursive CTE of the windows of texts (key, text): nth, a, b, ending after the last sentence mark, else before the last space, else hard."""
    rest = f"substring(text, {{0}} + 1, {size})"
    mark, space = (f"length(regexp_extract({rest}, '^.*{p}', 0, 's'))" for p in ("[.?!]", " "))

    def end(a: str) -> str:
        m, s = mark.format(a), space.format(a)
        return f"CASE WHEN {a} + {size} >= n THEN n WHEN {m} > 1 THEN {a} + {m} WHEN {s} > 1 THEN {a} + {s} - 1 ELSE {a} + {size} END"

    after = f"CASE WHEN b - {overlap} > a THEN b - {overlap} ELSE b END"
    return f"""{name} AS (SELECT key, text, n, 0 AS a, {end("0")} AS b FROM (SELECT key, text, length(text) AS n FROM {source}) z WHERE n > 0
      UNION ALL SELECT key, text, n, start, {end("start")} FROM (SELECT key, text, n, {after} AS start FROM {name} WHERE b < n) y)"""


def _adaptive() -> str:
    """Each question down its own route, with the vector of twice its id."""
    distance = "list_sum(list_transform(list_zip(v.embedding, q.query), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))"
    ents = f"list_filter({_Q_ENTITIES}, lambda x, i: list_position({_Q_ENTITIES}, x) = i)"

    def ranked(table: str, by: str = "distance, vec_id") -> str:
        return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}) AS rank FROM {table}"

    node_boost = "CASE WHEN node_type = node_type_filter THEN 1.5 ELSE 1.0 END * CASE WHEN list_contains(ents, entity_name) THEN 2.0 ELSE 1.0 END"
    edge_boost = "CASE WHEN len(list_filter(temporal, lambda t: contains(year, t))) > 0 THEN 1.3 ELSE 1.0 END"

    def boosted(table: str, boost: str) -> str:
        final = f"(SELECT * EXCLUDE (rank), rank AS input_rank, least(distance * {boost}, 1.0) AS final_score FROM {table} WHERE rank <= 10 AND route = 'hybrid')"
        return ranked(final, "final_score DESC, input_rank")

    out = "SELECT CAST(query_id AS VARCHAR) AS query_id, '{}' AS kind, rank, {} AS id, '{}' AS method FROM {}"
    route = "CASE WHEN intent IN ('entity_lookup', 'relationship') THEN 'graph' WHEN intent IN ('exploration', 'factual') THEN 'hybrid' ELSE 'vector' END"
    vec = "CAST(vec_id AS VARCHAR)"
    return f"""{_BY_GRAPH}, {_NODE_VECTORS}, {_EDGE_VECTORS},
      asks AS (SELECT q.*, {ents} AS ents, {_Q_TEMPORAL} AS temporal, {_NODE_TYPE} AS node_type_filter, {_INTENT} AS intent, {route} AS route, e.embedding AS query
        FROM (SELECT *, question AS ascii FROM {_values(fx.QUESTIONS, "query_id, question")} v) q JOIN embeddings e ON e.vec_id = 2 * q.query_id),
      near AS ({ranked(f"(SELECT q.*, v.vec_id, v.node_type, v.entity_name, {distance} AS distance FROM asks q, nv v WHERE route <> 'graph')")}),
      enear AS ({ranked(f"(SELECT q.*, v.vec_id, v.year, {distance} AS distance FROM asks q, ev v WHERE route <> 'graph')")}),
      vn AS ({ranked("(SELECT * EXCLUDE (rank) FROM near WHERE rank <= 20 AND route = 'vector' AND (node_type_filter IS NULL OR node_type = node_type_filter))")}),
      hn AS ({boosted("near", node_boost)}), he AS ({boosted("enear", edge_boost)})
      {out.format("node", vec, "vector_search", "vn WHERE rank <= 10")} UNION ALL {out.format("edge", vec, "vector_search", "enear WHERE rank <= 10 AND route = 'vector'")}
      UNION ALL {out.format("node", vec, "hybrid", "hn")} UNION ALL {out.format("edge", vec, "hybrid", "he")}
      UNION ALL {out.format("node", "name", "graph_traversal", "gn WHERE query_id IN (SELECT query_id FROM asks WHERE route = 'graph')")}
      UNION ALL {out.format("edge", "source || '_' || type || '_' || target", "graph_traversal", "ge WHERE query_id IN (SELECT query_id FROM asks WHERE route = 'graph')")}"""


#: What the written files hold: the texts of a source, a line each; the cells of a customer.
_TEXT_FILES = "(SELECT string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY source)"
_CUSTOMER_LINE = "'Row ' || i || ': c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', c_nationkey: ' || c_nationkey"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

ORACLES: dict[str, str] = {
    "chunk_csv_row_kv": "SELECT 'row_' || c_custkey AS chunk_id, c_custkey AS row_index, 'c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_mktsegment: ' || c_mktsegment AS text, 'csv_row' AS chunk_type FROM customer",
    "chunk_csv_row_sentence": "SELECT 'row_' || c_custkey AS chunk_id, 'The c_custkey is ' || c_custkey || '. The c_name is ' || c_name || '. The c_nationkey is ' || c_nationkey || '.' AS text FROM customer",
    "chunk_csv_row_json": """SELECT 'row_' || c_custkey AS chunk_id, '{"c_custkey": "' || c_custkey || '", "c_name": "' || c_name || '", "c_nationkey": "' || c_nationkey || '"}' AS text FROM customer""",
    "chunk_sentence": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS s FROM documents),
      c AS (SELECT doc_id, s, unnest(range(0, len(s), 2)) AS a FROM p WHERE len(s) > 0)
      SELECT doc_id, a // 2 AS chunk_index, array_to_string(s[a + 1 : a + 3], ' ') AS text, a AS sentence_start, least(a + 3, len(s)) AS sentence_end, 'sentence' AS chunk_type FROM c""",
    "chunk_fixed": f"""WITH RECURSIVE d AS (SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL), {_windows("d", "w", 500, 50)},
      t AS (SELECT key, a, b, {_TRIM.format("substring(text, a + 1, b - a)")} AS body FROM w)
      SELECT key AS doc_id, row_number() OVER (PARTITION BY key ORDER BY a) - 1 AS chunk_index, body AS text, a AS start_char, b AS end_char, 'fixed_size' AS chunk_type FROM t WHERE body <> ''""",
    "chunk_semantic": f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, chr(10) || '+'), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS ps FROM documents),
      p AS (SELECT doc_id, i, ps[i] AS para, length(ps[i]) AS n FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM l)),
      g AS (SELECT doc_id, i, CASE WHEN n > 1000 THEN 0 ELSE n END AS held, 1 AS nth FROM p WHERE i = 1
        UNION ALL SELECT g.doc_id, p.i, CASE WHEN p.n > 1000 THEN 0 WHEN g.held = 0 OR g.held + p.n > 1000 THEN p.n ELSE g.held + p.n END,
          CASE WHEN p.n > 1000 OR g.held = 0 OR g.held + p.n > 1000 THEN g.nth + 1 ELSE g.nth END FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1),
      c AS (SELECT p.*, g.nth FROM p JOIN g ON g.doc_id = p.doc_id AND g.i = p.i),
      long AS (SELECT struct_pack(doc_id, nth) AS key, para AS text FROM c WHERE n > 1000), {_windows("long", "w", 1000, 50)},
      t AS (SELECT key, a, b, {_TRIM.format("substring(text, a + 1, b - a)")} AS body FROM w),
      s AS (SELECT key.doc_id AS doc_id, key.nth AS nth, row_number() OVER (PARTITION BY key ORDER BY a) - 1 AS piece, body, a, b FROM t WHERE body <> ''),
      o AS (SELECT doc_id, nth, 0 AS piece, string_agg(para, chr(10) || chr(10) ORDER BY i) AS body, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b, 'semantic' AS kind FROM c WHERE n <= 1000 GROUP BY doc_id, nth
        UNION ALL SELECT doc_id, nth, piece, body, a, b, 'semantic_split' FROM s)
      SELECT doc_id, CASE WHEN kind = 'semantic' THEN row_number() OVER (PARTITION BY doc_id ORDER BY nth, piece) - 1 ELSE piece END AS chunk_index, body AS text, a AS start_char, b AS end_char, kind AS chunk_type FROM o""",
    "chunk_token_estimate": "SELECT doc_id, length(text) // 4 AS tokens FROM documents",
    "entities_keyword": f"""WITH {_KEYWORD} SELECT chunk_id, source_doc AS source, text, type, confidence, "start", "end" FROM ent""",
    **{n: f"WITH {_KEYWORD} SELECT text, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM ent WHERE type = '{t}' GROUP BY text" for n, t in (("entities_capitalized", "NAMED_ENTITY"), ("entities_email", "EMAIL"), ("entities_number", "NUMBER"))},
    "entities_url": f"SELECT 'page_' || page_id AS chunk_id, unnest(regexp_extract_all(url || ' ' || coalesce(html, ''), {_text(_URL)})) AS text FROM pages",
    "entities_csv_relations": f"WITH {_ER}, {_ENT} SELECT {_OUT} FROM ent",
    "entities_csv_generic": " UNION ALL ".join(f"SELECT CAST(c_custkey AS VARCHAR) AS chunk_id, CAST({c} AS VARCHAR) AS text, 'CSV_{c.upper()}' AS type, '{c}' AS \"column\", {str(c == 'c_custkey').lower()} AS is_key, 1.0 AS confidence FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    "entities_evidence": f"""WITH {_ER}, {_ENT} SELECT text, type, count(*) AS n FROM ent WHERE "column" = 'evidence_note' GROUP BY ALL""",
    "entity_classify": f"WITH {_ER}, names AS (SELECT source AS text FROM er UNION SELECT target FROM er) SELECT text, {_classify('text', True)} AS as_source, {_classify('text', False)} AS as_target FROM names",
    "entity_target_type": f"WITH {_ER}, t AS (SELECT DISTINCT target_type, target FROM er) SELECT target_type, {_TARGET} AS mapped, count(*) AS n FROM t GROUP BY ALL",
    "entities_dedup": f"WITH {_ER}, {_ENT}, {_DEDUP} SELECT ord, {_OUT} FROM own",
    "entity_summary": f"WITH {_ER}, {_ENT}, {_DEDUP} SELECT type, count(*) AS n FROM own GROUP BY type",
    "entity_samples": f"WITH {_ER}, {_ENT}, {_DEDUP} SELECT type, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord) AS rank FROM own) WHERE rank <= 5",
    "llm_response_parse": rf"""WITH r AS ({fx.duck(fx.ANSWERED)}), l AS (SELECT chunk_id, string_split({_TRIM.format("line")}, '|') AS p, {_TRIM.format("line")} AS line FROM (SELECT chunk_id, unnest(string_split(response, chr(10))) AS line FROM r)),
      e AS (SELECT chunk_id, trim(replace(p[1], 'ENTITY:', '')) AS text, upper(trim(replace(p[2], 'TYPE:', ''))) AS type, try_cast(trim(replace(p[3], 'CONFIDENCE:', '')) AS DOUBLE) AS confidence FROM l WHERE starts_with(line, 'ENTITY:') AND len(p) >= 3)
      SELECT *, 'llm' AS extraction_method FROM e WHERE confidence IS NOT NULL""",
    "entities_csv_sections": f"""WITH {_SS}, parts AS (
      SELECT chunk_id, section AS text, 'SECTION' AS type, 'section' AS "column", true AS is_key, 1.0 AS confidence, NULL AS section, year, NULL AS parent_section FROM ss WHERE {_full("section")}
      UNION ALL SELECT chunk_id, subsection, 'SUBSECTION', 'subsection', true, 1.0, NULL, year, section FROM ss WHERE {_full("subsection")}
      UNION ALL SELECT chunk_id, perspective, 'PERSPECTIVE', 'perspective', false, 0.9, section, year, NULL FROM ss WHERE {_full("perspective")}
      UNION ALL SELECT chunk_id, replace(year, '.0', ''), 'YEAR', 'year', false, 1.0, NULL, NULL, NULL FROM ss WHERE {_full("year")}
      UNION ALL SELECT chunk_id, trim(t), 'TAG', 'tags', false, 0.8, section, year, NULL FROM (SELECT *, unnest(string_split(tags, ',')) AS t FROM ss) WHERE trim(t) <> ''
      UNION ALL SELECT chunk_id, t, {_classify("t", False)}, 'content', false, 0.7, section, year, NULL FROM (SELECT *, unnest({_all("regexp_replace(content, '[^\\x00-\\x7F]', '_', 'g')", _CAPITALISED)}) AS t FROM ss) WHERE length(t) BETWEEN 2 AND 50 AND lower(t) NOT IN ({_words(S.STOP_WORDS)}))
      SELECT * FROM parts""",
    "rel_cooccurrence": f"""WITH {_KEYWORD}, p AS (SELECT a.chunk_id, a.text AS source, b.text AS target, a.type AS source_type, b.type AS target_type, b."start" - a."start" AS dist,
        CASE WHEN a."end" < b."start" THEN {_TRIM.format('substring(a.body, a."end" + 1, b."start" - a."end")')} ELSE '' END AS context
      FROM ent a JOIN ent b ON a.chunk_id = b.chunk_id AND (b."start", b.rank, b.i) > (a."start", a.rank, a.i) AND b."start" - a."start" <= 100)
      SELECT chunk_id, source, target, 'CO_OCCURS' AS type, round(least(1.0, 0.5 + greatest(0.0, 1 - dist / 100) * 0.3 + 0.1 * ({" + ".join(f"CAST(contains(lower(context), '{w}') AS INTEGER)" for w in S.LINK_WORDS)})), 6) AS confidence, context, source_type, target_type FROM p""",
    "rel_pattern": " UNION ALL ".join(
        f"""SELECT chunk_id, a[i] AS source, b[i] AS target, '{kind}' AS type, {conf} AS confidence, c[i] AS context FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM (
          SELECT chunk_id, regexp_extract_all(text, {p}, 1) AS a, regexp_extract_all(text, {p}, 2) AS b, regexp_extract_all(text, {p}, 0) AS c FROM ({fx.duck(fx.TEXT_CHUNKS)}) t))"""
        for p, kind, conf in ((_text("(?i)" + p.replace(r"\w", r"[\p{L}\p{M}\p{N}_]")), k, c) for p, k, c in S.PATTERNS)
    ),
    "rel_csv_relations": f"WITH {_ER}, {_ENT}, {_DEDUP}, {_REL} SELECT chunk_id, source, target, type, confidence, year, section, value, unit, source_type, target_type FROM rel",
    "rel_csv_sections": f"""WITH {_SS}, s AS (SELECT *, {_YEAR} AS y FROM ss WHERE {_full("subsection")})
      SELECT chunk_id, section AS source, subsection AS target, 'HAS_SUBSECTION' AS type, 1.0 AS confidence, y AS year, NULL AS section FROM s WHERE {_full("section")}
      UNION ALL SELECT chunk_id, subsection, y, 'IN_YEAR', 1.0, NULL, NULL FROM s WHERE y <> ''
      UNION ALL SELECT chunk_id, subsection, perspective, 'HAS_PERSPECTIVE', 0.9, y, section FROM s WHERE {_full("perspective")}
      UNION ALL SELECT chunk_id, subsection, trim(t), 'TAGGED_WITH', 0.8, y, section FROM (SELECT *, unnest(string_split(tags, ',')) AS t FROM s) WHERE trim(t) <> ''""",
    "rel_csv_generic": " UNION ALL ".join(f"SELECT CAST(c_custkey AS VARCHAR) AS chunk_id, CAST(c_custkey AS VARCHAR) AS source, CAST({c} AS VARCHAR) AS target, 'HAS_{c.upper()}' AS type, '{c}' AS \"column\", 1.0 AS confidence FROM customer" for c in ("c_custkey", "c_name", "c_nationkey")),
    "rel_content_mentions": f"""WITH {_SS}, m AS (SELECT coalesce(nullif(subsection, ''), section) AS source, unnest({_all("regexp_replace(content, '[^\\x00-\\x7F]', '_', 'g')", _CAPITALISED)}) AS target FROM ss)
      SELECT source, target, 'MENTIONS_' || {_classify("target", False)} AS type, count(*) AS n, 0.7 AS confidence FROM m WHERE length(target) BETWEEN 3 AND 50 AND lower(target) NOT IN ({_words(S.STOP_WORDS)}) GROUP BY ALL""",
    "rel_dedup": f"WITH {_GRAPH} SELECT ord, source, target, type, confidence FROM red",
    "graph_nodes": f"""WITH {_GRAPH} SELECT node_id, node_type, name, confidence, chunk_id, "column", is_key, section, year, round(value, 6) AS value, unit FROM nodes""",
    "graph_chunk_nodes": f"WITH {_CHUNKS} SELECT chunk_id AS node_id, 'CHUNK' AS node_type, substring(text, 1, 500) AS text, source_doc AS source FROM chunks",
    "graph_edges": f"WITH {_GRAPH} SELECT edge_id, source, target, type, confidence, year, section, value, unit, evidence FROM edges",
    "graph_mentions": f"WITH {_ER}, {_ENT} SELECT chunk_id AS source, text AS target, 'MENTIONS' AS type, confidence, type AS entity_type FROM ent WHERE {_PRIMARY}",
    "graph_stats": f"""WITH {_GRAPH}, p AS (SELECT * FROM own WHERE {_PRIMARY}) SELECT 'total_nodes' AS kind, 'all' AS name, count(DISTINCT text) AS n FROM p UNION ALL SELECT 'node_type', type, count(*) FROM p GROUP BY type
      UNION ALL SELECT 'total_edges', 'all', count(*) FROM edges UNION ALL SELECT 'edge_type', type, count(*) FROM edges GROUP BY type""",
    "graph_node_types": f"WITH {_GRAPH} SELECT node_type, count(*) AS n FROM nodes GROUP BY ALL",
    "graph_edge_types": f"WITH {_GRAPH} SELECT type, count(*) AS n FROM edges GROUP BY ALL",
    "graph_degree": f"WITH {_GRAPH} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node",
    "graph_ego_compat": f"WITH RECURSIVE {_GRAPH}, {_hops(_values([('AFRICA',)], 'seed'), 1)} SELECT node, distance FROM reach WHERE node IN (SELECT node_id FROM nodes)",
    "graph_ego_khop": f"WITH RECURSIVE {_GRAPH}, {_hops(_values([('AFRICA',)], 'seed'), 2)} SELECT node, distance FROM reach WHERE node IN (SELECT node_id FROM nodes)",
    "graph_neighbors": f"WITH RECURSIVE {_GRAPH}, {_hops(_values([('AFRICA',), ('Brand#2',), ('Customer#000000001',)], 'seed'), 2)} SELECT * FROM (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS rank, node, distance FROM reach WHERE distance > 0) WHERE rank <= 100",
    "graph_related": _related(["EUROPE", "Supplier#000000001", "nobody"], 2),
    "graph_related_rows": _related(["AFRICA", "Brand#2", "Customer#000000001", "nobody"], 3),
    "graph_pattern_chain": f"""WITH {_GRAPH} SELECT p.source AS who, p.target AS "order", b.target AS nation, p.edge_id FROM edges p JOIN edges b ON b.source = p.source AND b.type = 'BASED_IN'
      JOIN edges r ON r.source = b.target AND r.type = 'PART_OF' AND r.target = 'EUROPE' WHERE p.type = 'PLACED' AND p.source IN (SELECT node_id FROM nodes) AND b.target IN (SELECT node_id FROM nodes)
      AND r.target IN (SELECT node_id FROM nodes) AND p.target IN (SELECT node_id FROM nodes WHERE node_type = 'METRIC')""",
    "graph_pattern_run": f"""WITH {_GRAPH}, e AS MATERIALIZED (SELECT source AS a, target AS b, edge_id FROM edges WHERE type IN ('SUPPLIES', 'IN_SECTION')),
      s AS (SELECT * FROM e UNION ALL SELECT b, a, edge_id FROM e WHERE a <> b), one AS (SELECT b, [edge_id] AS run FROM s WHERE a = 'Supplier#000000001'),
      two AS (SELECT s.b, list_append(run, edge_id) AS run FROM one JOIN s ON s.a = one.b AND NOT list_contains(run, edge_id)),
      r AS (SELECT b, 1 AS length FROM one UNION ALL SELECT b, 2 FROM two) SELECT b AS name, length, count(*) AS n FROM r WHERE b IN (SELECT node_id FROM nodes) GROUP BY b, length""",
    "graph_pattern_loop": f"""WITH {_GRAPH}, e AS MATERIALIZED (SELECT source, target, type, edge_id FROM edges WHERE type IN ('BASED_IN', 'IN_SECTION'))
      SELECT y.source AS name, t.target AS section FROM e x JOIN e y ON y.target = x.target AND y.edge_id <> x.edge_id JOIN e s ON s.source = x.source JOIN e t ON t.source = y.source AND t.target = s.target AND t.edge_id <> s.edge_id
      WHERE x.source = 'Customer#000000001' AND x.type = 'BASED_IN' AND y.type = 'BASED_IN' AND s.type = 'IN_SECTION' AND t.type = 'IN_SECTION' AND y.source IN (SELECT node_id FROM nodes)
      AND x.target IN (SELECT node_id FROM nodes) AND t.target IN (SELECT node_id FROM nodes WHERE node_type = 'SECTION')""",
    "graph_entity_lookup": f"WITH {_GRAPH} SELECT node_id, node_type, confidence FROM nodes WHERE name = 'NATION_3' ORDER BY node_type, node_id LIMIT 1",
    "graph_upsert_nodes": f"""WITH {_ER}, {_ENT} SELECT type AS node_type, text AS name, {", ".join(f'arg_max("{c}", ord) FILTER (WHERE "{c}" IS NOT NULL) AS "{c}"' for c in ("confidence", "chunk_id", "column", "is_key", "section", "year"))},
      round(arg_max(value, ord) FILTER (WHERE value IS NOT NULL), 6) AS value, arg_max(unit, ord) FILTER (WHERE unit IS NOT NULL) AS unit FROM ent WHERE {_PRIMARY} GROUP BY type, text""",
    "graph_upsert_edges": f"""WITH {_GRAPH} SELECT source, upper(translate(type, ' -', '__')) AS type, target, {", ".join(f"arg_max({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("confidence", "year", "section", "value", "unit", "evidence"))}
      FROM edges e WHERE source IN (SELECT name FROM nodes) AND target IN (SELECT name FROM nodes) GROUP BY source, upper(translate(e.type, ' -', '__')), target""",
    "graph_rel_query": f"WITH {_GRAPH} SELECT source, target, type, confidence FROM edges WHERE type = 'PART_OF' ORDER BY source, type, target, ord LIMIT 100",
    "graph_db_stats": f"""WITH {_GRAPH}, u AS (SELECT DISTINCT source, upper(translate(type, ' -', '__')) AS type, target FROM edges WHERE source IN (SELECT name FROM nodes) AND target IN (SELECT name FROM nodes))
      SELECT node_type AS name, count(*) AS n, 'nodes' AS kind FROM nodes GROUP BY ALL UNION ALL SELECT type, count(*), 'relationships' FROM u GROUP BY ALL""",
    "graph_sql": f"WITH {_GRAPH} SELECT n.node_type, e.type, count(*) AS n FROM nodes n JOIN edges e ON n.name = e.source WHERE e.confidence >= 0.9 GROUP BY ALL",
    "graph_for_indexing": f"WITH {_GRAPH} SELECT 'node' AS kind, node_type AS type, name AS id FROM nodes WHERE node_type IN ('ORGANIZATION', 'CONCEPT', 'ENTITY') UNION ALL SELECT 'edge', type, edge_id FROM edges WHERE type IN ('SUPPLIES', 'BASED_IN')",
    "node_text": f"WITH {_GRAPH} SELECT node_id, node_type || ': ' || name || coalesce(' | Section: ' || section, '') || coalesce(' | Year: ' || year, '') || coalesce(' | Value: ' || value || ' ' || unit, '') AS text FROM nodes",
    "edge_text": f"WITH {_GRAPH} SELECT edge_id, source || ' ' || lower(replace(type, '_', ' ')) || ' ' || target || coalesce(' | Context: ' || substring(evidence, 1, 100), '') || coalesce(' | in ' || section, '') || coalesce(' | (' || year || ')', '') AS text FROM edges",
    "vec_topk": f"{_VEC} SELECT {_HIT} FROM near WHERE query_id = 0 AND rank <= 10",
    "vec_topk_batch": f"{_VEC} SELECT {_HIT} FROM near WHERE rank <= 10",
    "vec_ann_ivf_all_cells": f"{_VEC} SELECT {_HIT} FROM near WHERE rank <= 10",
    "vec_topk_filtered_post": f"{_VEC} SELECT {_HIT} FROM ({_FILTERED} node_type = 'L3') WHERE rank <= 10",
    "vec_topk_filtered_pre": f"{_VEC}, f AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near WHERE node_type = 'L3') SELECT {_HIT} FROM f WHERE rank <= 10",
    "vec_similarity_threshold": f"{_VEC} SELECT query_id, vec_id, round(1 / (1 + distance), 6) AS similarity FROM near WHERE rank <= 20 AND 1 / (1 + distance) >= 0.45",
    "vec_stats": "SELECT count(*) AS total_vectors, max(len(embedding)) AS dimension, 'flat' AS index_type FROM embeddings",
    "vec_lookup": f"WITH {_NODE_VECTORS} SELECT vec_id, node_type, entity_name FROM nv WHERE entity_name = 'Vec 7'",
    "vec_add": f"WITH {_NODE_VECTORS}, {_ASKED} SELECT vec_id, node_type, entity_name FROM nv UNION ALL SELECT (SELECT max(vec_id) FROM nv) + row_number() OVER (ORDER BY query_id), 'NEW', 'New ' || query_id FROM q",
    "upsert_antijoin": "SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labelled', 'q' || quality FROM labels",
    "delete_by_id": "SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "question_intent": f"WITH {_QUESTIONS} SELECT query_id, {_INTENT} AS intent FROM q",
    "question_entities": _unrolled(f"list_filter({_Q_ENTITIES}, lambda x, i: list_position({_Q_ENTITIES}, x) = i)", "entities"),
    "question_keywords": _unrolled(_Q_KEYWORDS, "keywords"),
    "question_temporal": _unrolled(_Q_TEMPORAL, "temporal"),
    "question_filters": f"WITH {_QUESTIONS} SELECT query_id, {_NODE_TYPE} AS node_type_filter, len({_Q_TEMPORAL}) > 0 AS has_temporal FROM q",
    "question_validate": f"WITH {_GRAPH}, {_QUESTIONS}, e AS (SELECT query_id, unnest(list_filter({_Q_ENTITIES}, lambda x, i: list_position({_Q_ENTITIES}, x) = i)) AS entity FROM q) SELECT query_id, entity, entity IN (SELECT name FROM nodes) AS exists FROM e",
    "retrieve_vector": f"{_VECTOR} SELECT CAST(query_id AS VARCHAR) AS query_id, 'node' AS kind, rank, CAST(vec_id AS VARCHAR) AS id, node_type AS type, round(distance, 6) AS score FROM vn WHERE rank <= 10 UNION ALL SELECT CAST(query_id AS VARCHAR), 'edge', rank, CAST(vec_id AS VARCHAR), relationship_type, round(distance, 6) FROM ve",
    "retrieve_graph": f"{_BY_GRAPH} SELECT CAST(query_id AS VARCHAR) AS query_id, 'node' AS kind, rank, name AS id, NULL AS type, CAST(score AS DOUBLE) AS score FROM gn UNION ALL SELECT CAST(query_id AS VARCHAR), 'edge', rank, source || '_' || type || '_' || target, type, 0.8 FROM ge",
    "retrieve_hybrid": f"{_HYBRID} SELECT CAST(query_id AS VARCHAR) AS query_id, 'node' AS kind, rank, CAST(vec_id AS VARCHAR) AS id, node_type AS type, round(distance, 6) AS score, round(final_score, 6) AS final_score, CAST(boost AS DOUBLE) AS boost FROM hn UNION ALL SELECT CAST(query_id AS VARCHAR), 'edge', rank, CAST(vec_id AS VARCHAR), relationship_type, round(distance, 6), round(final_score, 6), boost FROM he",
    "retrieve_adaptive_route": f"WITH {_QUESTIONS}, i AS (SELECT query_id, {_INTENT} AS intent FROM q) SELECT *, CASE WHEN intent IN ('entity_lookup', 'relationship') THEN 'graph' WHEN intent IN ('exploration', 'factual') THEN 'hybrid' ELSE 'vector' END AS route FROM i",
    "retrieve_adaptive": _adaptive(),
    "rerank_boost_distance": f"{_VEC} SELECT query_id, rank, input_rank, vec_id, CAST(boost AS DOUBLE) AS boost, round(final_score, 6) AS final_score FROM ({_rerank('distance', _BOOST, 'near', 20)})",
    "rerank_boost_similarity": f"{_VEC} SELECT query_id, rank, input_rank, vec_id, CAST(boost AS DOUBLE) AS boost, round(final_score, 6) AS final_score FROM ({_rerank('(1 / (1 + distance))', _BOOST, 'near', 20)})",
    "rerank_boost_edges": f"{_VEC2} SELECT query_id, rank, vec_id, CAST(boost AS DOUBLE) AS boost, round(final_score, 6) AS final_score FROM ({_rerank('distance', _EBOOST, 'enear', 20)})",
    "context_entities": f"{_HYBRID} SELECT CAST(query_id AS VARCHAR) AS query_id, rank, entity_name AS name, node_type AS type, round(final_score, 6) AS score, CAST(boost AS DOUBLE) AS boost FROM hn",
    "context_sources": f"{_VECTOR}, s AS (SELECT DISTINCT query_id, 'Section: ' || section AS s FROM ve) SELECT CAST(query_id AS VARCHAR) AS query_id, string_agg(s, ';' ORDER BY s) AS sources FROM s GROUP BY query_id",
    "context_graph_text": _graph_context(),
    "context_vector_text": _vector_context("SELECT query_id, context_text, length(context_text) // 4 AS token_count FROM ctx"),
    "context_hybrid_text": _hybrid_context("SELECT query_id, context_text, length(context_text) // 4 AS token_count FROM ctx"),
    "context_truncate": _vector_context(f"""SELECT query_id, over AS truncated, cut AS context_text, length(cut) // 4 AS token_count FROM (SELECT query_id, length(context_text) // 4 > 200 AS over,
      CASE WHEN over THEN substring(context_text, 1, 800) || {_text(S.CUT_MARK)} ELSE context_text END AS cut FROM ctx)"""),
    "answer_confidence": _vector_context(f"SELECT query_id, {_CONFIDENCE} AS confidence FROM ctx"),
    "answer_prompt": _vector_context(f"SELECT query_id, {_prompt(A.SOURCED)} AS prompt, {_prompt(A.CITED)} AS citation_prompt FROM ctx"),
    "answer_offline": _vector_context(f"SELECT ctx.query_id, '' AS answer, {_CONFIDENCE} AS confidence, coalesce(n_sources, 0) AS n_sources FROM ctx LEFT JOIN src ON src.query_id = ctx.query_id"),
    "answer_citations": _hybrid_context(f"SELECT query_id, length({_prompt(A.CITED)}) || ' characters' AS answer, {_CONFIDENCE} AS confidence, sources FROM ctx"),
    "vec_edge_filtered": f"""{_VEC2}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS fit FROM enear WHERE rank <= 20 AND relationship_type = 'NEXT_L3')
      SELECT query_id, fit AS rank, vec_id, relationship_type, round(distance, 6) AS distance FROM f WHERE fit <= 10""",
    "graph_ego_edges": f"""WITH RECURSIVE {_GRAPH}, {_hops(_values([("AFRICA",)], "seed"), 2)},
      inner_ AS (SELECT node FROM reach WHERE distance < 2 AND node IN (SELECT node_id FROM nodes)) SELECT edge_id, source, target, type FROM edges WHERE source IN (FROM inner_) OR target IN (FROM inner_)""",
    "graph_upsert_chunks": """SELECT 'doc_' || d.doc_id AS chunk_id, source AS doc_id, text, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'stored' END AS state FROM documents d
      UNION ALL SELECT 'conv_' || conv_id || '_' || turn, role, text, NULL FROM conversations""",
    "graph_add_chunks": f"""WITH {_KEYWORD} SELECT 'node' AS kind, text AS id, NULL AS target FROM ent GROUP BY text UNION ALL SELECT 'node', chunk_id, NULL FROM chunks
      UNION ALL SELECT DISTINCT 'edge', chunk_id, text FROM ent""",
    "load_text": f"SELECT 'text' AS file_type, md5(content) AS digest, length(content) AS n_chars, length(content) AS size, CAST(NULL AS BIGINT) AS row_count FROM {_TEXT_FILES}",
    "load_markdown": f"SELECT 'markdown' AS file_type, md5(content) AS digest, length(content) AS n_chars, length(content) AS size, CAST(NULL AS BIGINT) AS row_count FROM {_TEXT_FILES}",
    "load_json": """WITH o AS (SELECT c_nationkey, c_custkey, '{' || chr(10) || '  "c_custkey": ' || c_custkey || ',' || chr(10) || '  "c_name": "' || c_name || '"' || chr(10) || '}' AS j FROM customer),
      f AS (SELECT c_nationkey, arg_min(j, c_custkey) AS j FROM o GROUP BY c_nationkey)
      SELECT 'json' AS file_type, string_agg(j, chr(10) || chr(10) ORDER BY c_custkey) AS content FROM o GROUP BY c_nationkey UNION ALL SELECT 'json', j FROM f UNION ALL SELECT 'json', CAST(r_regionkey AS VARCHAR) FROM region""",
    "load_csv": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, true AS gapless FROM customer",
    "load_csv_document": f"SELECT 'csv' AS file_type, string_agg({_CUSTOMER_LINE}, chr(10) ORDER BY c_custkey) AS content, count(*) AS row_count FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer)",
    "load_directory": f"""WITH n AS (SELECT *, c_nationkey % 5 AS k, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS i FROM customer),
      t AS (SELECT 'csv' AS file_type, string_agg({_CUSTOMER_LINE}, chr(10)) AS content, count(*) AS row_count FROM n GROUP BY k
        UNION ALL SELECT 'text', string_agg(c_name, chr(10)) || chr(10), NULL FROM n GROUP BY k)
      SELECT file_type, count(*) AS n_files, CAST(sum(length(content)) AS BIGINT) AS n_chars, CAST(sum(row_count) AS BIGINT) AS row_count FROM t GROUP BY file_type""",
    "json_sinks": f"WITH {_ER}, {_ENT}, {_DEDUP}, c AS (SELECT type, count(*) AS n FROM own GROUP BY type) SELECT 'lines' AS sink, type, n FROM c UNION ALL SELECT 'list', type, n FROM c",
    "json_docs_to_text": "SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS text FROM events",
    "hybrid_expand": f"""{_VEC.replace("WITH", "WITH RECURSIVE", 1)}, {_EDGE_VECTORS}, ed AS (SELECT source, target, relationship_type AS type, 'v' || lpad(CAST(vec_id AS VARCHAR), 12, '0') AS edge_id FROM ev),
      own AS (SELECT query_id, rank AS nth, entity_name AS seed FROM near WHERE rank <= 5), {_trails("ed", "(SELECT DISTINCT seed FROM own) s", 2)},
      r AS (SELECT * FROM (SELECT seed, node, path[1] AS first, row_number() OVER (PARTITION BY seed ORDER BY length, array_to_string(path, chr(31)), node) AS n FROM trail WHERE length > 0) WHERE n <= 50)
      SELECT query_id, string_agg(DISTINCT node, ';' ORDER BY node) AS nodes, count(DISTINCT node) AS node_count, count(DISTINCT (nth, first)) AS edge_count FROM own JOIN r ON r.seed = own.seed GROUP BY query_id""",
    "retrieve_similar_and_related": f"""{_VEC.replace("WITH", "WITH RECURSIVE", 1)}, {_EDGE_VECTORS}, hit AS (SELECT query_id, entity_name AS name, 1 / (1 + distance) AS similarity_score, 'vector' AS origin FROM near WHERE rank <= 20 AND 1 / (1 + distance) >= 0.45),
      sd AS (SELECT * FROM (SELECT query_id, name AS seed, row_number() OVER (PARTITION BY query_id ORDER BY name) AS n FROM (SELECT DISTINCT query_id, name FROM hit)) WHERE n <= 5),
      link AS (SELECT source AS a, target AS b FROM ev UNION SELECT target, source FROM ev),
      walk AS (SELECT DISTINCT seed, seed AS node, 0 AS d FROM sd UNION SELECT w.seed, l.b, w.d + 1 FROM walk w JOIN link l ON l.a = w.node WHERE w.d < 2),
      reach AS (SELECT seed, node, min(d) AS d FROM walk GROUP BY ALL),
      u AS (SELECT * FROM hit UNION ALL SELECT query_id, node, 0.5 / (d + 1), 'graph' FROM sd JOIN reach ON reach.seed = sd.seed WHERE d > 0)
      SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, origin DESC, name) AS rank, name, round(similarity_score, 6) AS similarity_score, origin FROM u) WHERE rank <= 10""",
}

# what is written and read again
_COUNTS = """SELECT 'nodes' AS part, node_type AS type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edges', type, count(*) FROM edges GROUP BY ALL"""
_NODE_TEXT = ORACLES["node_text"].split("SELECT node_id, ", 1)[1].rsplit(" AS text FROM", 1)[0]
_EDGE_TEXT = ORACLES["edge_text"].split("SELECT edge_id, ", 1)[1].rsplit(" AS text FROM", 1)[0]
_KINDS = "SELECT '{}' AS extractor, type, count(*) AS n FROM {} GROUP BY type"
ORACLES |= {
    "sink_entities": f"WITH {_ER}, {_ENT}, {_DEDUP} SELECT {_OUT} FROM own",
    "sink_relations": ORACLES["rel_dedup"],
    "sink_statistics": ORACLES["graph_stats"],
    "sink_answers": f"SELECT question AS name, query_id AS n FROM ({fx.duck(fx.ASKED)}) q UNION ALL SELECT unnest(['nodes', 'edges']), count(*) FROM embeddings",
    "store_vectors": f"WITH {_NODE_VECTORS} SELECT vec_id, node_type, entity_name, len(embedding) AS dimension FROM nv",
    "store_graph": f"WITH {_GRAPH} {_COUNTS} UNION ALL SELECT 'cleared', unnest(['nodes', 'edges']), 0",
    "index_graph": f"WITH {_GRAPH} SELECT 'nodes' AS store, node_id AS id, {_NODE_TEXT} AS text, true AS embedded, true AS gapless FROM nodes UNION ALL SELECT 'edges', source || '_' || type || '_' || target, {_EDGE_TEXT}, true, true FROM edges",
    "index_statistics": f"WITH {_GRAPH} SELECT 'nodes' AS store, count(*) AS total_vectors, 16 AS dimension, true AS ready FROM nodes UNION ALL SELECT 'edges', count(*), 16, true FROM edges",
    "embed_statistics": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS total_node_embeddings, 16 AS embedding_dimension, (SELECT count(*) FROM edges) AS total_edge_embeddings",
    "chunker_factory": " UNION ALL ".join(f"SELECT chunk_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ({ORACLES[n]}) {n} GROUP BY chunk_type" for n in ("chunk_fixed", "chunk_sentence", "chunk_semantic")),
    "extractor_factories": f"WITH {_ER}, {_ENT}, {_DEDUP}, {_REL} {_KINDS.format('entities csv', 'ent')} UNION ALL {_KINDS.format('entities keyword', '(' + ORACLES['entities_keyword'] + ') k')} UNION ALL {_KINDS.format('relations csv', 'rel')} UNION ALL {_KINDS.format('relations pattern', '(' + ORACLES['rel_pattern'] + ') p')}",
    "llm_entities": rf"""SELECT chunk_id, w AS text, upper('word' || length(w)) AS type, CAST(0.5 AS DOUBLE) AS confidence, 'llm' AS extraction_method FROM (SELECT chunk_id, regexp_extract(text, '\S+') AS w FROM ({fx.duck(fx.TEXT_CHUNKS)}) c) WHERE w <> ''""",
    "llm_prompts": f"""SELECT chunk_id, md5('Find the entities of these types in the text below: PERSON, ORGANIZATION' || chr(10) || chr(10) || 'Text:' || chr(10) || text || chr(10) || chr(10) || 'Answer with one line for each entity:' || chr(10)
      || 'ENTITY: <text> | TYPE: <type> | CONFIDENCE: <score>' || chr(10)) AS digest FROM ({fx.duck(fx.TEXT_CHUNKS)}) c""",
    "chunk_nodes_without_ids": f"SELECT CASE WHEN length(text) % 3 = 0 THEN 'chunk_' || sha256(concat_ws(chr(31), source_doc, ord, text)) ELSE chunk_id END AS node_id, source_doc AS source FROM ({fx.duck(fx.TEXT_CHUNKS)}) c",
    "loader_of_ones_own": "SELECT event_type AS doc_id, 'log' AS file_type, md5(string_agg(event_id || ' ' || event_type, chr(10) ORDER BY event_id) || chr(10)) AS digest, count(*) AS row_count FROM events GROUP BY event_type",
    "vector_store_statistics": f"WITH n AS (SELECT count(*) AS n, max(len(embedding)) AS dimension FROM embeddings), {_ASKED} SELECT n AS total_vectors, dimension, 'flat' AS index_type, 'before' AS state FROM n UNION ALL SELECT n + (SELECT count(*) FROM q), dimension, 'flat', 'after' FROM n",
}

# the stored graph answers as the graph itself, and so does the one that follows a stream
for _name, _same in (("stream_degree", "graph_degree"), ("stream_nodes", "graph_upsert_nodes"), ("graph_index_related", "graph_related_rows"), ("graph_index_ego", "graph_ego_khop"), ("graph_index_lookup", "graph_entity_lookup")):
    ORACLES[_name] = ORACLES[_same]

# literals with a point are decimals in DuckDB
for _name in ("entities_keyword", "entities_csv_generic", "entities_csv_sections", "rel_pattern", "rel_csv_sections", "rel_csv_generic", "rel_content_mentions"):
    ORACLES[_name] = f"SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({ORACLES[_name]}) x"


def job_graph_sql() -> str:
    """The graph of all documents: sentence chunks, the entities in them and the relationships that patterns tell, as nodes and edges."""
    key = "lpad(coalesce(CAST(doc_id AS VARCHAR), 'null'), 20, '0') || '#' || lpad(CAST(chunk_index AS VARCHAR), 8, '0') || '#' || substr(sha256(text), 1, 12)"
    stop = f"length(t) BETWEEN 2 AND 50 AND lower(t) NOT IN ({_words(S.STOP_WORDS)})"
    kinds = [("ascii", _CAPITALISED, "NAMED_ENTITY", 0.7, stop), ("text", _EMAIL, "EMAIL", 1.0, "true"), ("text", _URL, "URL", 1.0, "true"), ("ascii", _NUMBER, "NUMBER", 1.0, "true")]
    found = " UNION ALL ".join(f"SELECT chunk_id, doc_id, t, '{kind}' AS kind, CAST({conf} AS DOUBLE) AS confidence FROM (SELECT chunk_id, doc_id, unnest({_all(column, p)}) AS t FROM chunks) WHERE {keep}" for column, p, kind, conf, keep in kinds)
    said = " UNION ALL ".join(
        f"""SELECT chunk_id, i, a[i] AS source, b[i] AS target, '{kind}' AS type, CAST({conf} AS DOUBLE) AS confidence, c[i] AS context FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM (
          SELECT chunk_id, regexp_extract_all(text, {p}, 1) AS a, regexp_extract_all(text, {p}, 2) AS b, regexp_extract_all(text, {p}, 0) AS c FROM chunks))"""
        for p, kind, conf in ((_text("(?i)" + p.replace(r"\w", r"[\p{L}\p{M}\p{N}_]")), k, c) for p, k, c in S.PATTERNS)
    )
    return f"""WITH s AS ({ORACLES["chunk_sentence"]}), chunks AS (SELECT DISTINCT {key} AS chunk_id, doc_id, text, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS ascii FROM s),
      found AS ({found}), m AS (SELECT chunk_id, doc_id, t, kind, max(confidence) AS confidence, count(*) AS n FROM found GROUP BY ALL),
      said AS ({said}), r AS (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target), type ORDER BY chunk_id, i) AS nth FROM said)
      SELECT 'node' AS part, kind AS type, t AS source, NULL AS target, NULL AS confidence, count(*) AS n, count(DISTINCT doc_id) AS n_docs, NULL AS text FROM m GROUP BY t, kind
      UNION ALL SELECT 'node', 'CHUNK', chunk_id, NULL, NULL, NULL, NULL, text FROM chunks
      UNION ALL SELECT 'edge', 'MENTIONS', chunk_id, t, confidence, n, NULL, NULL FROM m
      UNION ALL SELECT 'edge', type, source, target, confidence, NULL, NULL, context FROM r WHERE nth = 1"""


def job_questions_sql() -> str:
    """The users' turns as questions, each once."""
    return f"""WITH t AS (SELECT DISTINCT conv_id, turn, text AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL),
      a AS (SELECT *, regexp_replace(question, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}]', '_', 'g') AS ascii FROM t),
      p AS (SELECT *, {_INTENT} AS intent, {_Q_ENTITIES} AS ents FROM a)
      SELECT conv_id, turn, question, intent, array_to_string(list_filter(ents, lambda x, i: list_position(ents, x) = i), '|') AS entities, array_to_string({_Q_KEYWORDS}, '|') AS keywords,
        array_to_string({_Q_TEMPORAL}, '|') AS temporal, {_NODE_TYPE} AS node_type_filter,
        CASE WHEN intent IN ('entity_lookup', 'relationship') THEN 'graph' WHEN intent IN ('exploration', 'factual') THEN 'hybrid' ELSE 'vector' END AS route FROM p"""
