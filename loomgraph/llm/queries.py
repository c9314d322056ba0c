"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from loomgraph.functions.text import NARROW, WIDE
from loomgraph.llm import components, format_copies, leakage, name_variants, packing, repetition, subjects, survivor, term_counts
from loomgraph.plans.frames import table as t
from loomgraph.sql import strip

QUERIES = {
    "p1_found": lambda s, d: repetition.found(t(s, d, "relations")),
    "p2_found": lambda s, d: survivor.found(t(s, d, "relations")),
    "p3_found": lambda s, d: components.found(t(s, d, "alias_groups"), t(s, d, "merge_map")),
    "p4_found": lambda s, d: name_variants.found(t(s, d, "relations"), t(s, d, "new_entities"), t(s, d, "entity")),
    "p5_found": lambda s, d: term_counts.found(t(s, d, "candidate")),
    "p6_found": lambda s, d: format_copies.found(t(s, d, "relations"), t(s, d, "relation_spec")),
    "p7_prompts_2048": lambda s, d: packing.packed(t(s, d, "documents"), 2048),
    "p7_prompts_8192": lambda s, d: packing.packed(t(s, d, "documents"), 8192),
    "p8_found": lambda s, d: leakage.found(t(s, d, "documents"), t(s, d, "held_out")),
    "p9_found": lambda s, d: subjects.found(t(s, d, "documents"), t(s, d, "held_out"), labels=t(s, d, "subject_labels"), areas=t(s, d, "subject_area")),
    "p1_shares": lambda s, d: repetition.shares(t(s, d, "relations")),
    "p1_response_shares": lambda s, d: repetition.response_shares(t(s, d, "relations")),
    "p1_bands": lambda s, d: repetition.bands(t(s, d, "relations")),
    "p2_withheld": lambda s, d: survivor.withheld(t(s, d, "relations")),
    "p2_golden_edges": lambda s, d: survivor.golden_edges(t(s, d, "relations")),
    "p3_group_sizes": lambda s, d: components.group_sizes(t(s, d, "alias_groups"), t(s, d, "merge_map")),
    "p5_terms": lambda s, d: term_counts.marked(t(s, d, "candidate")),
    "p6_collapsed": lambda s, d: format_copies.collapsed(t(s, d, "relations"), t(s, d, "relation_spec")),
    "p7_fill": lambda s, d: packing.quality(packing.packed(t(s, d, "documents"), 2048), 2048),
    "p8_items": lambda s, d: leakage.leaked_items(t(s, d, "documents"), t(s, d, "held_out")),
    "p9_make_up": lambda s, d: subjects.make_up(t(s, d, "documents"), t(s, d, "held_out"), labels=t(s, d, "subject_labels"), areas=t(s, d, "subject_area")),
}


def _bare(x: str) -> str:
    return f"regexp_replace(lower(translate({x}, '{WIDE}', '{NARROW}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_STAND_INS = ", ".join(f"'{w}'" for w in survivor.STAND_INS)
_TAIL = r"[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}”’」』）)\]】》\"''—-]+$".replace("{{", "{").replace("}}", "}")

#: The rest of problems 1, 4, 7, 8 and 9 isn't expressible in SQL over whole tables; tests hold them against brute force.
ORACLE = {
    "p2_found": f"""
WITH c AS (SELECT edge_id, assertion_id AS id, extracted_at AS ts, regexp_replace(evidence, '{_TAIL}', '') AS e, {_bare("evidence")} AS b,
  CASE {strip("evidence_src")} WHEN '模型引用' THEN 2 WHEN '程序检索' THEN 1 ELSE 0 END AS src, len(list_distinct(list_filter(chapters, lambda x: x > 0))) AS n FROM relations WHERE edge_id IS NOT NULL),
r AS (SELECT *, coalesce(b <> '' AND b NOT IN ({_STAND_INS}) AND regexp_matches(e, '[。．.｡！!？?]$') AND NOT regexp_matches(e, '([.．。]\\s*){{2,}}$|…[。．.]?$'), false) AS ok FROM c),
g AS (SELECT edge_id, count(*) AS k, arg_max(id, (src, ts, -id)) FILTER (WHERE ok) AS evidence_from, arg_max(id, (n, ts, -id)) FILTER (WHERE n > 0) AS chapters_from FROM r GROUP BY edge_id)
SELECT edge_id, evidence_from, chapters_from FROM g WHERE k >= 2 AND evidence_from IS NOT NULL AND chapters_from IS NOT NULL""",
    "p3_found": """
WITH RECURSIVE m AS (SELECT group_id, book, unnest(members) AS n FROM alias_groups WHERE book IS NOT NULL),
f AS (SELECT group_id, book, n FROM m WHERE n <> ''),
x AS (SELECT a.book, a.n AS u, b.n AS v FROM (SELECT group_id, book, min(n) AS n FROM f GROUP BY 1, 2) a JOIN f b USING (group_id)
  UNION SELECT book, alias, canon FROM merge_map WHERE book IS NOT NULL AND alias <> '' AND canon <> ''),
e AS (SELECT book, u, v FROM x WHERE u <> v UNION SELECT book, v, u FROM x WHERE u <> v),
w AS (SELECT book, u AS name, u AS reached FROM e UNION SELECT w.book, w.name, e.v FROM w JOIN e ON e.book = w.book AND e.u = w.reached)
SELECT book, name, min(reached) AS group_name FROM w GROUP BY book, name""",
    "p5_found": f"""
WITH n AS (SELECT {strip("name")} AS name, book, pack, max(freq) AS f FROM candidate WHERE freq >= 1 GROUP BY 1, 2, 3),
g AS (SELECT name, sum(f) AS occurrences, count(*) AS records FROM n WHERE name <> '' GROUP BY name), t AS (SELECT count(*) AS total FROM (SELECT DISTINCT book, pack FROM candidate) x)
SELECT name, 'rare' AS mark FROM g WHERE occurrences < 3 UNION ALL SELECT name, 'common' FROM g, t WHERE records > 0.1 * total""",
    "p6_found": f"""
WITH c AS (SELECT assertion_id, book, {_bare("head")} AS h, {_bare("relation")} AS r, {_bare("tail")} AS t, {_bare("evidence")} AS e FROM relations),
k AS (SELECT assertion_id, book, r, e, CASE WHEN s.n IS NOT NULL THEN least(h, t) ELSE h END AS x, CASE WHEN s.n IS NOT NULL THEN greatest(h, t) ELSE t END AS y
  FROM c LEFT JOIN (SELECT DISTINCT {_bare("name")} AS n FROM relation_spec WHERE "symmetric") s ON s.n = c.r WHERE h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL AND e <> '')
SELECT first_id, assertion_id AS copy_id FROM (SELECT assertion_id, min(assertion_id) OVER (PARTITION BY book, r, e, x, y) AS first_id FROM k) z WHERE first_id <> assertion_id""",
}

_SURVIVORS = ORACLE["p2_found"].replace("SELECT edge_id, evidence_from, chapters_from FROM g WHERE", "s AS (SELECT * FROM g WHERE").rstrip() + ")"
ORACLE["p2_golden_edges"] = f"""{_SURVIVORS.replace("evidence_from, arg_max", "evidence_from, arg_max").replace("FROM r GROUP BY edge_id)", "FROM r GROUP BY edge_id),", 1)}
SELECT s.edge_id, e.head, e.relation, e.tail, e.evidence, {strip("e.evidence_src")} AS evidence_src, s.evidence_from,
  array_to_string(list_sort(list_distinct(list_filter(c.chapters, lambda x: x > 0))), ',') AS chapters, s.chapters_from, s.k AS merged
FROM s JOIN relations e ON e.assertion_id = s.evidence_from JOIN relations c ON c.assertion_id = s.chapters_from"""
ORACLE["p1_shares"] = f"""
WITH b AS (SELECT assertion_id, {_bare("evidence")} AS e, {_bare("relation")} AS r FROM relations),
p AS (SELECT assertion_id, e, unnest(range(1, length(e) - 6)) AS i FROM b WHERE length(e) >= 8),
g AS (SELECT assertion_id, i, row_number() OVER (PARTITION BY assertion_id, substring(e, CAST(i AS INTEGER), 8) ORDER BY i) AS k FROM p),
c AS (SELECT assertion_id, count(*) AS n FROM (SELECT DISTINCT assertion_id, unnest(range(i, i + 8)) AS at FROM g WHERE k > 1) x GROUP BY assertion_id)
SELECT b.assertion_id, CASE WHEN e <> '' THEN round(coalesce(c.n, 0) / length(e), 4) END AS repeated,
  coalesce(length(r) >= 4 AND strpos(substring(r || r, 3), r) BETWEEN 1 AND length(r) - 2, false) AS word_repeated FROM b LEFT JOIN c USING (assertion_id)"""
ORACLE["p1_response_shares"] = f"""
SELECT response_id, count(*) AS texts, round((count(*) - count(DISTINCT e)) / count(*), 4) AS repeated
FROM (SELECT response_id, {_bare("evidence")} AS e FROM relations WHERE response_id IS NOT NULL) x WHERE e <> '' GROUP BY response_id"""
ORACLE["p3_group_sizes"] = f"SELECT book, group_name, count(*) AS names FROM ({ORACLE['p3_found']}) x GROUP BY 1, 2"
ORACLE["p5_terms"] = ORACLE["p5_found"].partition("SELECT name, 'rare'")[0] + "SELECT name, CAST(occurrences AS BIGINT) AS occurrences, records, occurrences < 3 AS rare, records > 0.1 * total AS common FROM g, t"
ORACLE["p6_collapsed"] = ORACLE["p6_found"].partition("SELECT first_id, assertion_id AS copy_id")[0] + "SELECT min(assertion_id) AS assertion_id, count(*) AS copies FROM k GROUP BY book, r, e, x, y"
