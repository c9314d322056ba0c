"""Pieces of the ANSI SQL that each query is checked against."""

from __future__ import annotations

#: White space of any kind as a character class of the checking engine.
_CLASS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_CLASS}+|{_CLASS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{_CLASS}+', '', 'g')"


def trimmed(x: str) -> str:
    """Null for a blank."""
    return f"NULLIF({strip(x)}, '')"


#: Every name form of the registry and its canon.
ALIAS = f"""alias AS (
  SELECT DISTINCT book, name, canon, type, entity_id FROM (
    SELECT book, canon AS name, canon, type, entity_id FROM entity
    UNION ALL SELECT book, {strip("a")}, canon, type, entity_id FROM (SELECT book, canon, type, entity_id, unnest(aliases) AS a FROM entity) x WHERE a IS NOT NULL) y
  WHERE name <> '')"""

FORMS = """forms AS (SELECT book, canon, list(DISTINCT name) AS names FROM alias GROUP BY book, canon)"""

#: Relation names as models write them.
RELATION_ALIAS = """relation_alias AS (
  SELECT '「' || name || '」' AS alias, name AS relation FROM relation_spec UNION ALL SELECT name || '。', name FROM relation_spec)"""

SPEC = """spec AS (SELECT name, domain, range, directed, "symmetric" AS sym, functional_on, definition,
  CASE WHEN strpos(definition, '→') > 0 THEN split_part(definition, '→', 1) ELSE name END AS func_group FROM relation_spec)"""

#: Text of a pack: the quotations of its assertions that run to a full stop.
PACK = f"""sents AS (
  SELECT book, pack, e, min(assertion_id) AS id FROM (SELECT book, pack, {strip("evidence")} AS e, assertion_id FROM relations) x
  WHERE e IS NOT NULL AND (suffix(e, '。') OR (suffix(e, '.') AND NOT suffix(e, '..'))) GROUP BY book, pack, e),
pack_text AS (SELECT book, pack, string_agg(e, chr(10) ORDER BY id) AS text FROM sents GROUP BY book, pack)"""

_MENTION = "len(list_filter({forms}, lambda n: contains({text}, n))) > 0"


def mention(forms: str, text: str) -> str:
    return _MENTION.format(forms=forms, text=text)


#: Names resolved, relation normalized, types checked, direction turned where only the turned one fits.
CHECKED = f"""
base AS (
  SELECT assertion_id, book, pack, chapters, round, response_id, seq, confidence, {strip("head")} AS h0, {strip("tail")} AS t0, {strip("relation")} AS r0,
         {trimmed("evidence")} AS ev, {strip("evidence_src")} AS src FROM relations),
named AS (
  SELECT b.*, a.canon AS h1, c.canon AS t1, a.type AS ht, c.type AS tt, coalesce(ra.relation, b.r0) AS r
  FROM base b LEFT JOIN alias a ON a.book = b.book AND a.name = b.h0 LEFT JOIN alias c ON c.book = b.book AND c.name = b.t0
  LEFT JOIN relation_alias ra ON ra.alias = b.r0),
typed AS (
  SELECT n.*, s.domain, s.range, s.sym,
         s.name IS NOT NULL AND s.domain = n.ht AND s.range = n.tt AS fits,
         s.name IS NOT NULL AND s.domain <> s.range AND s.domain = n.tt AND s.range = n.ht AS turns
  FROM named n LEFT JOIN spec s ON s.name = n.r),
checked AS (
  SELECT assertion_id, book, pack, chapters, round, response_id, seq, confidence, r, ev, src, sym,
         CASE WHEN NOT fits AND turns THEN t1 ELSE h1 END AS h, CASE WHEN NOT fits AND turns THEN h1 ELSE t1 END AS t,
         coalesce(NOT fits AND turns, false) AS flipped,
         CASE WHEN h1 IS NULL THEN 'unregistered:' || coalesce(h0, '') WHEN t1 IS NULL THEN 'unregistered:' || coalesce(t0, '')
              WHEN h1 = t1 THEN 'same' WHEN domain IS NULL THEN 'not in set:' || coalesce(r, '')
              WHEN NOT fits AND NOT turns THEN 'type:' || r || '(' || ht || '→' || tt || ')' END AS reason
  FROM typed)"""

#: Windows of one to three sentences of each pack.
WINDOWS = f"""
pieces AS (SELECT book, pack, unnest(list_filter(list_transform(string_split_regex(text, '[。！？；\\n]'), lambda x: {strip("x")}), lambda x: x <> '')) AS s,
  generate_subscripts(list_filter(list_transform(string_split_regex(text, '[。！？；\\n]'), lambda x: {strip("x")}), lambda x: x <> ''), 1) AS pos FROM pack_text),
lined AS (SELECT book, pack, pos, s, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2 FROM pieces WINDOW w AS (PARTITION BY book, pack ORDER BY pos)),
windows AS (
  SELECT book, pack, pos, 1 AS w, s FROM lined WHERE length(s) <= 80
  UNION ALL SELECT book, pack, pos, 2, s || '。' || s1 FROM lined WHERE s1 IS NOT NULL AND length(s || '。' || s1) <= 160
  UNION ALL SELECT book, pack, pos, 3, s || '。' || s1 || '。' || s2 FROM lined WHERE s2 IS NOT NULL AND length(s || '。' || s1 || '。' || s2) <= 160)"""

GROUNDED = f"""
quoted AS (
  SELECT c.*, fh.names AS hn, ft.names AS tn,
         coalesce(contains({squeeze("p.text")}, {squeeze("c.ev")}), false) AS grounded,
         coalesce({mention("fh.names", "c.ev")} AND {mention("ft.names", "c.ev")}, false) AS both_named
  FROM checked c LEFT JOIN pack_text p ON p.book = c.book AND p.pack = c.pack
  LEFT JOIN forms fh ON fh.book = c.book AND fh.canon = c.h LEFT JOIN forms ft ON ft.book = c.book AND ft.canon = c.t WHERE c.reason IS NULL),
searched AS (
  SELECT q.assertion_id, arg_min(x.s, (x.w, length(x.s), x.pos)) AS s
  FROM quoted q JOIN windows x ON x.book = q.book AND x.pack = q.pack
  WHERE NOT (q.grounded AND q.both_named) AND {mention("q.hn", "x.s")} AND {mention("q.tn", "x.s")} GROUP BY q.assertion_id),
validated AS (
  SELECT c.*, CASE WHEN c.reason IS NOT NULL THEN NULL WHEN q.grounded AND q.both_named THEN c.ev ELSE s.s END AS evidence,
         CASE WHEN c.reason IS NOT NULL THEN NULL WHEN q.grounded AND q.both_named THEN '模型引用' WHEN s.s IS NOT NULL THEN '程序检索' END AS evidence_src,
         coalesce(c.reason, CASE WHEN NOT (q.grounded AND q.both_named) AND s.s IS NULL THEN 'no evidence' END) AS why
  FROM checked c LEFT JOIN quoted q USING (assertion_id) LEFT JOIN searched s USING (assertion_id))"""

VALIDATED = ", ".join((ALIAS, FORMS, RELATION_ALIAS, SPEC, PACK, CHECKED, WINDOWS, GROUNDED))


def votes(where: str = "true", name: str = "cand") -> str:
    """Candidate edges by canonical key with votes, mentions, chapters and best evidence."""
    return f"""
{name}_rows AS (
  SELECT book, r AS relation, CASE WHEN sym THEN least(h, t) ELSE h END AS head, CASE WHEN sym THEN greatest(h, t) ELSE t END AS tail,
         assertion_id, evidence, evidence_src, chapters, pack, {squeeze("evidence")} AS ev_key FROM validated WHERE why IS NULL AND ({where})),
{name}_first AS (SELECT * FROM {name}_rows QUALIFY row_number() OVER (PARTITION BY book, head, relation, tail, ev_key ORDER BY assertion_id) = 1),
{name}_best AS (SELECT *, row_number() OVER (PARTITION BY book, head, relation, tail ORDER BY CASE WHEN evidence_src = '模型引用' THEN 0 ELSE 1 END, length(evidence), assertion_id) AS k FROM {name}_first),
{name} AS (
  SELECT m.*, b.votes, b.evidence, b.evidence_src, b.evidences FROM
    (SELECT book, head, relation, tail, count(*) AS mentions, min(assertion_id) AS seq, count(DISTINCT pack) AS packs FROM {name}_rows GROUP BY ALL) m
    JOIN (SELECT book, head, relation, tail, count(*) AS votes, max(CASE WHEN k = 1 THEN evidence END) AS evidence, max(CASE WHEN k = 1 THEN evidence_src END) AS evidence_src,
                 string_agg(CASE WHEN k <= 3 THEN evidence END, ' | ' ORDER BY k) AS evidences FROM {name}_best GROUP BY ALL) b USING (book, head, relation, tail))"""
