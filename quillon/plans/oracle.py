"""The engine's queries in SQL, for side-by-side checks: text analysis, prefixes, expansion, scores."""

from __future__ import annotations

from ..functions.analyzer import Analysis, expand_synonyms
from .query import SearchOptions, expansion_keys

DEFAULT = Analysis()

#: documents with whole-number attributes.
CORPUS = r"""
corpus AS (SELECT d.doc_id, d.text, d.n_chars, try_cast(regexp_extract(d.source, '(\d+)$', 1) AS INT) AS source_n,
                  CASE d.lang WHEN 'en' THEN 1 WHEN 'de' THEN 3 WHEN 'fr' THEN 4 WHEN 'es' THEN 5 ELSE 0 END AS lang_n, l.quality, l.toxic
           FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id))"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(words: list[str] | tuple[str, ...]) -> str:
    """A list of string literals."""
    return ", ".join(map(_q, words))


def normal(col: str, a: Analysis = DEFAULT) -> str:
    """Expression for the normalised text of a column."""
    x = f"lower(' ' || coalesce({col}, '') || ' ')"
    x = rf"regexp_replace({x}, '\r\n|\n\r|[\t\n\r]|&#13;', ' ', 'g')"
    for c in a.ignore_chars:
        x = f"replace({x}, {_q(c)}, '')"
    pairs = a.outside_folds
    if pairs:
        x = f"translate({x}, {_q(''.join(pairs))}, {_q(''.join(pairs.values()))})"
    x = f"regexp_replace({x}, {_q('[^' + a.keep_class + ']')}, ' ', 'g')"
    for c in a.blend_chars:
        for edge in (f" {c} ", f" {c}", f"{c} "):
            x = f"replace({x}, {_q(edge)}, ' ')"
    if a.separate_alnum:
        x = rf"regexp_replace(regexp_replace({x}, '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g')"
    return x


def occurrences(table: str, doc_id: str, fields: list[str] | tuple[str, ...], a: Analysis = DEFAULT) -> str:
    """CTEs up to occ (doc_id, field_id, pos, token)."""
    norm = " UNION ALL ".join(f"SELECT {doc_id}::BIGINT AS doc_id, {i} AS field_id, string_split({normal(f'{f}::VARCHAR', a)}, ' ') AS ws FROM {table}" for i, f in enumerate(fields))
    cases = ""
    for c in reversed(a.blend_chars):
        q = "\\" + c
        inner = f"regexp_replace(token, '^{q}+|{q}+$', '', 'g')"
        joined = f"replace({inner}, {_q(c)}, '')"
        cases += rf" WHEN regexp_matches(token, '^[\p{{L}}\p{{N}}{q}]+$') AND regexp_matches(token, '^.+{q}.+$') THEN CASE WHEN len(string_split({inner}, {_q(c)})) = length({joined}) AND length({joined}) > 2 THEN [{joined}] ELSE string_split({inner}, {_q(c)}) END"
    blended = "".join(c for c in a.blend_chars if c != "-")
    where = f"regexp_matches(token, '[{''.join(chr(92) + c for c in blended)}{chr(92)}-]')"
    out = f"""
norm AS ({norm}),
raw AS (SELECT doc_id, field_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM norm),
tok AS (SELECT doc_id, field_id, token, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY i) AS pos FROM raw WHERE token NOT IN ({values(a.forbidden)})),
cut AS (SELECT *, CASE {cases} ELSE [] END AS ps FROM tok WHERE {where}),
bits AS (SELECT doc_id, field_id, pos, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM cut),
blends AS (SELECT doc_id, field_id, p AS token, pos + row_number() OVER (PARTITION BY doc_id, field_id, pos ORDER BY k) - 1 AS pos FROM bits WHERE p <> '')"""
    both = "SELECT doc_id, field_id, pos, token FROM tok UNION ALL SELECT doc_id, field_id, pos, token FROM blends"
    table_ = expand_synonyms(a.synonyms)
    if table_:
        rows = ", ".join(f"({_q(w)}, {_q(m)})" for w, ms in table_.items() for m in ms)
        out += f",\nsyn(word, other) AS (VALUES {rows})"
        both += " UNION ALL SELECT doc_id, field_id, pos, other FROM tok JOIN syn ON token = word"
    return f"{out},\nocc AS ({both})"


def prefixes(mode: int, shortest: int = 3, a: Analysis = DEFAULT) -> str:
    """CTEs up to pre (prefix, token, cutlen), from occ."""
    size = "least(length(token), 20)"
    begin = f"SELECT substring(token, 1, {size} - c) AS prefix, token, c AS cutlen FROM cutting"
    end = "SELECT substring(token, c + 1) AS prefix, token, c AS cutlen FROM cutting"
    inner = f"SELECT substring(token, f + 1, {size} - c) AS prefix, token, c AS cutlen FROM (SELECT token, c, unnest(generate_series(0, c)) AS f FROM cutting)"
    parts = {0: [], 1: [begin], 2: [begin, end], 3: [inner]}[mode]
    folds = a.inside_folds
    if folds:
        folded = f"translate(token, {_q(''.join(folds))}, {_q(''.join(folds.values()))})"
        parts = [*parts, f"SELECT {folded} AS prefix, token, 0 AS cutlen FROM vocabulary WHERE {folded} <> token"]
    return f"""
vocabulary AS (SELECT DISTINCT token FROM occ),
cutting AS (SELECT token, unnest(generate_series(1, {size} - {shortest})) AS c FROM vocabulary WHERE {size} > {shortest}),
pre AS (SELECT DISTINCT prefix, token, cutlen FROM ({" UNION ALL ".join(parts)}))"""


def terms(words: list[str], o: SearchOptions = SearchOptions(), expand: bool = True, mode: int = 1, a: Analysis = DEFAULT) -> str:
    """CTE terms (token, q, quality): the words, and their expansions by the prefixes of occ."""
    exact = " UNION ALL ".join(f"SELECT {_q(w)} AS token, {q} AS q, 1.0::DOUBLE AS quality" for q, w in enumerate(words))
    keys = {k: w for w in reversed(words) for k in reversed(expansion_keys(w, a, o, 3))} if expand else {}
    owner: dict[str, str] = {}
    for w in words if expand else []:
        for k in expansion_keys(w, a, o, 3):
            owner.setdefault(k, w)
    if not keys:
        return f"terms AS ({exact})"
    rows = ", ".join(f"({_q(k)}, {_q(w)}, {i})" for i, (k, w) in enumerate(owner.items()))
    quality = f" AND round(length(prefix) / (length(prefix) + cutlen) * 100) >= {o.prefix_quality}" if o.prefix_quality else ""
    where = " OR ".join(f"(word = {_q(w)} AND q = {q})" for q, w in enumerate(words))
    return f"""{prefixes(mode, 3, a)},
keys(prefix, word, n) AS (VALUES {rows}),
near AS (SELECT * FROM pre JOIN keys USING (prefix) WHERE token NOT IN ({values(words)}) AND contains(token, prefix){quality}),
best AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY cutlen, n) AS r FROM near),
top AS (SELECT * FROM best WHERE r = 1 ORDER BY cutlen, token LIMIT {o.expansion_limit}),
terms AS ({exact} UNION ALL
          SELECT token, q, round((length(token) - least(levenshtein(prefix, token), levenshtein(word, token))) / length(token), 3) FROM top, (SELECT unnest([{", ".join(map(str, range(len(words))))}]) AS q) WHERE {where})"""


def hits(total: str, n_words: int, match: str = "ALL", rank: int = 1, weights: tuple[int, ...] = (1,), negative: tuple[str, ...] = (), disabled: str | None = None, adjacent: bool = False, quality: bool = True) -> str:
    """CTEs up to hit (doc_id, score), from occ and terms; one or two words."""
    enabled = ", ".join(str(i) for i, w in enumerate(weights) if w)
    weight = "CASE field_id " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    ok = {"ALL": " AND ".join(f"tf{q} IS NOT NULL" for q in range(n_words)), "ANY": "s IS NOT NULL"}
    ok["STRICT"] = ok["ALL"] + f" AND doc_id IN (SELECT doc_id FROM h WHERE q = 0 AND pos = 1 AND field_id IN ({enabled}))"
    where = ok[match]
    if negative:
        where += f" AND doc_id NOT IN (SELECT doc_id FROM occ WHERE token IN ({values(negative)}))"
    if disabled:
        where += f" AND doc_id NOT IN ({disabled})"
    if adjacent:
        where += " AND w > 0"
    e = ["tf0", "(w - bit_count(w) + tf1)"][:n_words]
    bm25 = " + ".join(f"coalesce({x} * i{q} / ({x} + 1.2::DOUBLE), 0::DOUBLE)" for q, x in enumerate(e))
    share = "(" + " + ".join(f"coalesce(l{q}, 0::DOUBLE)" for q in range(n_words)) + ") / (" + " + ".join(f"(tf{q} IS NOT NULL)::INT" for q in range(n_words)) + ")" if quality else "1::DOUBLE"
    part = f"round((0.5::DOUBLE + ({bm25}) / {2.0 * n_words}::DOUBLE) * 999)"
    base = {1: f"((w + s) * 1000 + {part})", 2: part, 3: "((w + s) * 1000)"}[rank]
    cols = ", ".join(f"max(tf) FILTER (q = {q}) AS tf{q}, max(ql) FILTER (q = {q}) AS l{q}" for q in range(n_words))
    idfs = ", ".join(f"(SELECT ln((n - df + 1) / df) / ln(1 + n) FROM df, total WHERE q = {q}) AS i{q}" for q in range(n_words))
    return f"""
total AS (SELECT count(*) AS n FROM {total}),
h AS (SELECT o.doc_id, o.field_id, o.pos, t.q, t.quality FROM occ o JOIN terms t USING (token)),
df AS (SELECT q, least((SELECT n FROM total), sum(m)) AS df FROM (SELECT t.q, o.token, count(DISTINCT o.doc_id) AS m FROM occ o JOIN terms t USING (token) GROUP BY ALL) GROUP BY q),
g AS (SELECT doc_id, q, count(*) AS tf, max(quality) AS ql FROM h GROUP BY ALL),
adj AS (SELECT doc_id, sum({weight})::BIGINT AS w FROM (SELECT DISTINCT b.doc_id, b.field_id FROM h a JOIN h b ON a.q = 0 AND b.q = 1 AND a.doc_id = b.doc_id AND a.field_id = b.field_id AND b.pos = a.pos + 1 WHERE b.field_id IN ({enabled})) GROUP BY 1),
own AS (SELECT doc_id, sum({weight})::BIGINT AS s FROM (SELECT DISTINCT doc_id, field_id FROM h WHERE field_id IN ({enabled})) GROUP BY 1),
wide AS (SELECT doc_id, {cols} FROM g GROUP BY doc_id),
all_in AS (SELECT wide.*, coalesce(w, 0) AS w, s, {idfs} FROM wide JOIN own USING (doc_id) LEFT JOIN adj USING (doc_id)),
hit AS (SELECT doc_id, trunc({base} * ({share}))::BIGINT AS score FROM all_in WHERE {where})"""


def query(final: str, *ctes: str) -> str:
    """WITH the CTEs, the final SELECT."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + final
