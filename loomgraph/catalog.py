"""The queries of the engine, each with the SQL it is checked against.

Every query runs over its whole tables.  Where the project has no table of a kind (a model's verdicts, gold triples, curated rows), the
query derives one from the assertions by a fixed rule, stated beside it and written the same way in the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import sql as q
from loomgraph.functions.text import squeeze, strip_all
from loomgraph.operators import aggregate, evaluate, extract, graph, infer, prescan, registry, review, structure, usage, validate
from loomgraph.plans.frames import cut, shared_folder, table
from loomgraph.sources import files, provider
from loomgraph.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GENERIC = ["夫人", "众人", "老仆", "那汉子", "the crowd", "an old servant"]
TYPES = ["人物", "地点", "势力"]
CATEGORY = {"父女": "kin", "母子": "kin", "夫妻": "marriage", "姻亲": "marriage", "结拜": "bond", "同窗": "bond", "师徒": "bond", "主仆": "service", "隶属": "power", "执掌": "power", "驻守": "place", "居住": "place"}
SYNONYMS = {"住在": "居住|驻守", "弟子": "师徒", "妻子": "夫妻", "丈夫": "夫妻", "仆人": "主仆"}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


# Text structuring ---------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS chars, lang FROM documents WHERE text IS NOT NULL")
def scan_documents(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("chars"), "lang")


_NUM = "[零〇一二两三四五六七八九十百千]+"


@query(f"""
WITH n AS (SELECT unnest(regexp_extract_all(evidence, '({_NUM})[遍两日年]', 1)) AS numeral FROM relations),
g AS (SELECT numeral, count(*) AS n FROM n GROUP BY numeral),
p AS (SELECT *, CASE WHEN regexp_extract(numeral, '(.)千', 1) = '' THEN 0 ELSE greatest(1, strpos('一二三四五六七八九', replace(regexp_extract(numeral, '(.)千', 1), '两', '二'))) * 1000 END AS k,
  CASE WHEN NOT contains(numeral, '百') THEN 0 ELSE greatest(1, strpos('一二三四五六七八九', replace(regexp_extract(numeral, '(.)百', 1), '两', '二'))) * 100 END AS h,
  CASE WHEN NOT contains(numeral, '十') THEN 0 ELSE greatest(1, CASE WHEN regexp_extract(numeral, '(.)十', 1) = '' THEN 1 ELSE strpos('一二三四五六七八九', replace(regexp_extract(numeral, '(.)十', 1), '两', '二')) END) * 10 END AS t,
  CASE WHEN right(numeral, 1) = '' THEN 0 ELSE strpos('一二三四五六七八九', replace(right(numeral, 1), '两', '二')) END AS o FROM g)
SELECT numeral, CAST(k + h + t + o AS INTEGER) AS value, n FROM p""")
def cn_numeral(s, d):
    n = table(s, d, "relations").select(F.explode(F.regexp_extract_all("evidence", F.lit(f"({_NUM})[遍两日年]"), F.lit(1))).alias("numeral"))
    return n.groupBy("numeral").agg(F.count("*").alias("n")).select("numeral", structure.numeral(F.col("numeral")).alias("value"), "n")


_HEADING = r"(?m)^(?:第(?:[0-9]+|[零〇一二两三四五六七八九十百千]+)[回章节卷]|Chapter [0-9]+\.)[^\n\r]*"


@query(f"""
WITH RECURSIVE h0 AS (
  SELECT book, coalesce(chapter, 2147483647) AS c, doc_id, unnest(regexp_extract_all(text, '{_HEADING}', 0)) AS title, generate_subscripts(regexp_extract_all(text, '{_HEADING}', 0), 1) AS pos
  FROM documents WHERE book IS NOT NULL AND text IS NOT NULL),
h AS (SELECT book, {q.strip("title")} AS title, CAST(regexp_extract(title, '^(第|Chapter )([0-9]+)', 2) AS INTEGER) AS number, row_number() OVER (PARTITION BY book ORDER BY c, doc_id, pos) AS rn FROM h0),
chain AS (
  SELECT book, title, number, rn, 1 AS i FROM h WHERE rn = 1
  UNION ALL
  SELECT n.book, n.title, n.number, n.rn, c.i + 1 FROM chain c JOIN h n ON n.book = c.book AND n.rn = (SELECT min(rn) FROM h x WHERE x.book = c.book AND x.rn > c.rn AND x.number = c.number + 1))
SELECT book, i AS "index", title, number FROM chain""")
def split_chapters(s, d):
    return structure.sequential_chapters(structure.headings(table(s, d, "documents")))


_CHAPTERS = "ch AS (SELECT book, chapter, min(doc_id) AS doc_id, arg_min(length(text), doc_id) AS chars FROM documents WHERE book IS NOT NULL AND chapter IS NOT NULL AND text IS NOT NULL GROUP BY book, chapter)"


@query(f"""
WITH RECURSIVE {_CHAPTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chapter) AS rn FROM ch),
w AS (
  SELECT book, rn, chapter, 1 AS p, 1 AS k, chars AS t FROM o WHERE rn = 1
  UNION ALL
  SELECT o.book, o.rn, o.chapter, CASE WHEN w.k >= 3 OR w.t + o.chars > 3000 THEN w.p + 1 ELSE w.p END, CASE WHEN w.k >= 3 OR w.t + o.chars > 3000 THEN 1 ELSE w.k + 1 END,
         CASE WHEN w.k >= 3 OR w.t + o.chars > 3000 THEN o.chars ELSE w.t + o.chars END
  FROM w JOIN o ON o.book = w.book AND o.rn = w.rn + 1)
SELECT book, format('p{{:03d}}', p) AS pack_id, string_agg(chapter, ',' ORDER BY rn) AS chapters, CAST(max(t) AS INTEGER) AS chars,
  CASE WHEN count(*) > 1 THEN '第' || min(chapter) || '–' || max(chapter) || '章' ELSE '第' || min(chapter) || '章' END AS label
FROM w GROUP BY book, p""")
def pack_chapters(s, d):
    return structure.pack_chapters(structure.chapters(table(s, d, "documents")), 3, 3000)


_PIECES = f"list_filter(list_transform(string_split_regex(text, '[。！？；\\n]'), lambda x: {q.strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(generate_subscripts({_PIECES}, 1) AS INTEGER) AS pos, unnest({_PIECES}) AS sentence FROM documents")
def split_sentences(s, d):
    return structure.sentences(table(s, d, "documents"))


@query("""
WITH m AS (SELECT doc_id, text, length(text) AS chars, CAST(floor(length(text) / 2) AS INTEGER) AS mid FROM documents WHERE length(text) >= 1500)
SELECT doc_id, CAST(mid + length(regexp_extract(substring(text, mid + 1), '^[^。！？]*[。！？]', 0)) AS INTEGER) AS cut, chars FROM m""")
def halve_document(s, d):
    return structure.halve(table(s, d, "documents"))


@query("SELECT doc_id, book, chapter FROM documents WHERE chapter BETWEEN 10 AND 40")
def chapter_range(s, d):
    return structure.chapter_range(table(s, d, "documents"), "10-40").select("doc_id", "book", "chapter")


_PACK_BODY = f"""{ORACLE["pack_chapters"].strip().removesuffix("FROM w GROUP BY book, p")}, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS text
FROM (SELECT w.*, d.text FROM w JOIN (SELECT book, chapter, arg_min(text, doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY book, chapter) d USING (book, chapter)) w GROUP BY book, p"""


def _packs(s, d):
    return structure.pack_bodies(table(s, d, "documents"), pack_chapters(s, d))


@query(f"SELECT book, pack_id, label, length(text) AS chars, md5(text) AS digest FROM ({_PACK_BODY}) z")
def pack_bodies(s, d):
    return _packs(s, d).select("book", "pack_id", "label", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query()
def chapter_texts(s, d):
    c = structure.chapter_texts(table(s, d, "documents"))
    return c.select("doc_id", "index", "title", "number", "start", F.length("body").alias("chars"), F.md5("body").alias("digest"))


@query()
def filter_fallback_split(s, d):
    """The refusing provider of this query refuses texts with left-over markup."""
    return structure.split_fallback(table(s, d, "documents"), refused=F.contains("text", F.lit("<br>")))


# Prescan ------------------------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in prescan.STOP)
_DIALOGUE = f"SELECT name, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '{prescan.DIALOGUE}', 1)) AS name FROM documents) x WHERE name <> '' AND name NOT IN ({_STOP}) AND NOT regexp_matches(name, '{prescan.GENERIC_SUFFIX}') GROUP BY name"
_NAMING = f"SELECT name, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(evidence, '{prescan.NAMING}', 1)) AS name FROM relations) x WHERE length(name) >= 2 AND name NOT IN ({_STOP}) GROUP BY name"
_TAGGED = "SELECT name, count(*) AS freq FROM (SELECT unnest(regexp_extract_all({c}, '" + prescan.TAGGED + "', 0)) AS name FROM documents) x GROUP BY name"


def _dialogue(s, d):
    return prescan.pattern_names(table(s, d, "documents"), "text", prescan.DIALOGUE, suffix=prescan.GENERIC_SUFFIX)


@query(_DIALOGUE)
def prescan_dialogue(s, d):
    return _dialogue(s, d)


@query(_NAMING)
def prescan_naming(s, d):
    return prescan.pattern_names(table(s, d, "relations"), "evidence", prescan.NAMING, least=2)


@query(_TAGGED.format(c="text"))
def prescan_token_type(s, d):
    return prescan.pattern_names(table(s, d, "documents"), "text", prescan.TAGGED, group=0)


@query(_TAGGED.format(c="title"))
def prescan_title(s, d):
    return prescan.pattern_names(table(s, d, "documents"), "title", prescan.TAGGED, group=0)


@query(f"""
WITH known AS (SELECT name FROM ({_DIALOGUE}) y),
runs AS (SELECT unnest(regexp_extract_all(text, '[一-龥]{{2,}}', 0)) AS r0 FROM documents),
clean AS (SELECT unnest(string_split_regex(r0, '[{prescan.FUNCTION}]')) AS r FROM runs),
grams AS (
  SELECT substring(r, CAST(i AS INTEGER), 2) AS gram FROM (SELECT r, unnest(range(1, length(r))) AS i FROM clean WHERE length(r) >= 2) a
  UNION ALL SELECT substring(r, CAST(i AS INTEGER), 3) FROM (SELECT r, unnest(range(1, length(r) - 1)) AS i FROM clean WHERE length(r) >= 3) b),
c AS (SELECT gram, count(*) AS freq FROM grams GROUP BY gram HAVING count(*) >= 8)
SELECT gram AS name, freq FROM c WHERE gram NOT IN ({_STOP}) AND NOT EXISTS (SELECT 1 FROM known k WHERE contains(k.name, c.gram)) ORDER BY freq DESC, gram LIMIT 120""")
def ngram_topk(s, d):
    return prescan.ngram_candidates(table(s, d, "documents").select("text"), _dialogue(s, d))


_FUSED = f"""
c0 AS (SELECT book, {q.strip("name")} AS name, unnest(sources) AS src FROM candidate WHERE book IS NOT NULL),
c1 AS (SELECT book, name, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM c0 WHERE name <> '' GROUP BY book, name),
k AS (SELECT c1.book, c1.name, sum((length(x.text) - length(replace(x.text, c1.name, ''))) // length(c1.name)) AS freq
      FROM c1 JOIN documents x ON x.book = c1.book AND contains(x.text, c1.name) GROUP BY c1.book, c1.name),
kept AS (SELECT c1.book, c1.name, CAST(coalesce(k.freq, 0) AS BIGINT) AS freq, c1.sources FROM c1 LEFT JOIN k ON k.book = c1.book AND k.name = c1.name),
fused AS (SELECT * FROM kept WHERE freq >= 3 OR regexp_matches(sources, 'naming|dialogue') QUALIFY row_number() OVER (PARTITION BY book ORDER BY freq DESC, name) <= 400)"""


def _fused(s, d):
    return prescan.fuse(table(s, d, "candidate"), table(s, d, "documents"))


@query(f"WITH {_FUSED} SELECT book, name, freq, sources FROM fused")
def prescan_candidates(s, d):
    return _fused(s, d)


@query(f"WITH {_FUSED} SELECT book, name || ' | ' || freq || ' | ' || sources AS line FROM fused QUALIFY row_number() OVER (PARTITION BY book ORDER BY freq DESC, name) <= 300")
def prescan_table(s, d):
    k = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("freq"), "name"))
    return _fused(s, d).withColumn("k", k).where("k <= 300").select("book", F.concat_ws(" | ", "name", "freq", "sources").alias("line"))


@query("""
WITH p AS (SELECT assertion_id, evidence AS t, head AS n, strpos(evidence, head) AS i FROM relations WHERE evidence IS NOT NULL AND head IS NOT NULL),
r AS (SELECT *, CASE WHEN i > 0 AND length(n) > 0 THEN strpos(substring(t, i + length(n)), n) ELSE 0 END AS j0 FROM p),
x AS (SELECT *, CASE WHEN j0 > 0 THEN i + length(n) + j0 - 1 ELSE 0 END AS j FROM r)
SELECT assertion_id, CASE WHEN i > 0 AND length(n) > 0 THEN
  replace(substring(t, greatest(1, i - 6), least(i - 1, 6) + length(n) + 6), chr(10), ' ')
  || CASE WHEN j > 0 THEN ' ｜ ' || replace(substring(t, greatest(1, j - 6), least(j - 1, 6) + length(n) + 6), chr(10), ' ') ELSE '' END ELSE '' END AS context FROM x""")
def kwic_context(s, d):
    r = table(s, d, "relations").where("evidence is not null and head is not null")
    return r.select("assertion_id", prescan.context(F.col("evidence"), F.col("head"), 6).alias("context"))


@query("""
WITH n AS (SELECT DISTINCT book, name FROM new_entities WHERE name <> ''),
k AS (SELECT n.book, n.name FROM n JOIN documents x ON x.book = n.book AND contains(x.text, n.name) GROUP BY 1, 2 HAVING sum((length(x.text) - length(replace(x.text, n.name, ''))) // length(n.name)) >= 3)
SELECT e.entry_id, e.book, e.name, e.type FROM new_entities e JOIN k USING (book, name) WHERE e.type IN ('人物', '地点', '势力')""")
def lexicon_filter(s, d):
    """Candidates: names that stand at least three times in the documents of their book."""
    e = table(s, d, "new_entities")
    names = prescan.exact_counts(table(s, d, "documents"), e.where("name <> ''")).where("freq >= 3")
    return prescan.lexicon_filter(e, names, TYPES).select("entry_id", "book", "name", "type")


@query(f"""
WITH freq AS (SELECT book, {q.strip("name")} AS name, sum(freq) AS f FROM candidate WHERE book IS NOT NULL AND freq >= 1 GROUP BY 1, 2),
typed AS (SELECT book, name, arg_min(type, entry_id) AS type FROM new_entities WHERE book IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2),
m0 AS (SELECT DISTINCT group_id, book, unnest(members) AS name FROM alias_groups WHERE book IS NOT NULL),
m AS (SELECT m0.*, freq.f, typed.type, row_number() OVER (PARTITION BY group_id ORDER BY f DESC, m0.name) AS k, count(*) OVER (PARTITION BY group_id) AS n
      FROM m0 JOIN freq USING (book, name) LEFT JOIN typed USING (book, name) WHERE m0.name <> ''),
g AS (SELECT * FROM m WHERE n >= 2)
SELECT book, group_id, arg_min(name, k) AS name, coalesce(arg_min(type, CASE WHEN type IS NOT NULL THEN k END), '人物') AS type,
       coalesce(string_agg(CASE WHEN k > 1 THEN name END, ',' ORDER BY k), '') AS aliases, CAST(sum(f) AS BIGINT) AS freq FROM g GROUP BY book, group_id
UNION ALL SELECT t.book, NULL, t.name, t.type, '', CAST(f.f AS BIGINT) FROM typed t JOIN freq f USING (book, name) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.book = t.book AND g.name = t.name)""")
def lexicon_merge_groups(s, d):
    return prescan.merge_groups(table(s, d, "alias_groups"), table(s, d, "new_entities"), table(s, d, "candidate"))


@query("""SELECT '- ' || name || '（' || domain || '→' || range || CASE WHEN "symmetric" THEN '，对称' ELSE '' END || '）：' || definition AS line FROM relation_spec""")
def schema_describe(s, d):
    return prescan.describe(table(s, d, "relation_spec"))


# Registry -----------------------------------------------------------------------------------------------------------------------


def _alias(s, d):
    return registry.alias_index(table(s, d, "entity"))


@query(f"""
WITH r AS (SELECT book, name, entry_id, pack, CASE WHEN {q.strip("identity")} <> '' THEN identity END AS identity, CASE WHEN {q.strip("type")} <> '' THEN type END AS type FROM new_entities WHERE book IS NOT NULL AND name IS NOT NULL)
SELECT book, name, count(*) AS mentions, arg_max(identity, CASE WHEN identity IS NOT NULL THEN (length(identity), -entry_id) END) AS identity,
       arg_min(type, CASE WHEN type IS NOT NULL THEN entry_id END) AS type, count(DISTINCT pack) AS packs FROM r GROUP BY book, name""")
def registry_build(s, d):
    return registry.build(table(s, d, "new_entities"))


_CLAIMED = "list_append(coalesce(aliases, []), substring(name, 1, 1) || '氏')"
_CLAIMS = f"""claims AS (SELECT * FROM (SELECT book, {q.strip("a")} AS alias, name, entry_id, pos FROM
  (SELECT book, name, entry_id, unnest(aliases) AS a, generate_subscripts(aliases, 1) - 1 AS pos FROM new_entities WHERE book IS NOT NULL AND name IS NOT NULL) x) y WHERE alias <> '' AND alias <> name),
owners AS (SELECT book, alias, arg_min(name, (entry_id, pos, name)) AS owner FROM (
  SELECT book, alias, name, entry_id, pos FROM claims UNION ALL SELECT DISTINCT book, name, name, -1, 0 FROM new_entities WHERE book IS NOT NULL AND name IS NOT NULL) z GROUP BY book, alias)"""


@query(f"WITH {_CLAIMS} SELECT book, alias, owner FROM owners")
def alias_first_owner(s, d):
    return registry.first_owners(table(s, d, "new_entities"))


@query(f"WITH {_CLAIMS.replace('unnest(aliases)', f'unnest({_CLAIMED})').replace('generate_subscripts(aliases, 1)', f'generate_subscripts({_CLAIMED}, 1)')} SELECT DISTINCT c.book, c.alias, c.name AS claimant, o.owner FROM claims c JOIN owners o USING (book, alias) WHERE c.name <> o.owner")
def alias_conflicts(s, d):
    """Each report claims its first character with 氏 besides, so that names conflict."""
    claimed = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.concat(F.substring("name", 1, 1), F.lit("氏"))))
    return registry.alias_conflicts(table(s, d, "new_entities").withColumn("aliases", claimed))


@query(f"""WITH {q.ALIAS} SELECT r.assertion_id, a.canon AS head_canon, b.canon AS tail_canon FROM relations r
LEFT JOIN alias a ON a.book = r.book AND a.name = {q.strip("r.head")} LEFT JOIN alias b ON b.book = r.book AND b.name = {q.strip("r.tail")}""")
def resolve_names(s, d):
    a = _alias(s, d)
    r = registry.resolve(registry.resolve(table(s, d, "relations"), a, "head", "head_canon"), a, "tail", "tail_canon")
    return r.select("assertion_id", "head_canon", "tail_canon")


_SURNAMES = """surnames AS (SELECT DISTINCT CASE WHEN length(canon) >= 4 THEN substring(canon, 1, 2) ELSE substring(canon, 1, 1) END AS surname FROM entity WHERE type = '人物' AND regexp_matches(canon, '^[一-龥]+$'))"""


def _surname(c: str) -> str:
    return f"(CASE WHEN length({c}) >= 2 AND substring({c}, 1, 2) IN (SELECT surname FROM surnames WHERE length(surname) = 2) THEN substring({c}, 1, 2) WHEN substring({c}, 1, 1) IN (SELECT surname FROM surnames WHERE length(surname) = 1) THEN substring({c}, 1, 1) END)"


@query(f"""
WITH {_CLAIMS}, {_SURNAMES}, freq AS (SELECT book, {q.strip("name")} AS n, sum(freq) AS f FROM candidate WHERE freq >= 1 GROUP BY 1, 2),
p AS (SELECT DISTINCT c.book, c.name AS canon, c.alias, e.type, coalesce(f1.f, 0) AS cf, coalesce(f2.f, 0) AS af FROM claims c JOIN entity e ON e.book = c.book AND e.canon = c.name
      LEFT JOIN freq f1 ON f1.book = c.book AND f1.n = c.name LEFT JOIN freq f2 ON f2.book = c.book AND f2.n = c.alias),
s AS (SELECT *, {_surname("canon")} AS cs, {_surname("alias")} AS als FROM p)
SELECT book, canon, alias, CASE
  WHEN alias IN ({", ".join(f"'{g}'" for g in GENERIC)}) OR alias = als THEN 'generic'
  WHEN length(alias) = 1 THEN CASE WHEN suffix(canon, alias) AND cf >= 100 THEN NULL ELSE 'short' END
  WHEN type = '人物' AND length(alias) = 2 AND length(canon) BETWEEN 2 AND 3 AND substring(alias, 1, 1) = substring(canon, 1, 1) AND als IS NOT NULL AND substring(alias, 2) <> substring(canon, 2) THEN 'same surname'
  WHEN type = '人物' AND cs IS NOT NULL AND als IS NOT NULL AND cs <> als THEN 'other surname'
  WHEN (type <> '人物' OR als IS NOT NULL) AND af >= 20 AND af >= 0.5 * greatest(cf, 1) AND NOT suffix(canon, alias) THEN 'strong' END AS reason FROM s""")
def alias_guard(s, d):
    return registry.alias_guard(table(s, d, "new_entities"), table(s, d, "entity"), table(s, d, "candidate"), GENERIC)


@query("""
WITH RECURSIVE p AS (SELECT book, greatest(alias, canon) AS dropped, min(least(alias, canon)) AS keep FROM merge_map WHERE book IS NOT NULL AND alias <> '' AND canon <> '' AND alias <> canon GROUP BY 1, 2),
w AS (SELECT book, dropped, keep FROM p UNION ALL SELECT w.book, w.dropped, p.keep FROM w JOIN p ON p.book = w.book AND p.dropped = w.keep)
SELECT book, dropped, min(keep) AS root FROM w GROUP BY book, dropped""")
def registry_merge(s, d):
    return registry.keep_map(table(s, d, "merge_map"))


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY mentions DESC, ord, canon) AS rank,
  coalesce(list_aggregate(list_sort(list_filter(aliases, lambda x: x IS NOT NULL AND x <> '')), 'string_agg', '｜'), '') AS al FROM entity)
SELECT book, rank, '- ' || canon || CASE WHEN al <> '' THEN '（' || al || '）' ELSE '' END || '［' || coalesce(type, '') || '］' || CASE WHEN identity <> '' THEN '：' || identity ELSE '' END AS line FROM e WHERE rank <= 10""")
def registry_topn(s, d):
    return registry.render(table(s, d, "entity"), 10)


@query(f"""
WITH {q.PACK}, n AS (SELECT e.book, coalesce(contains(p.text, {q.strip("e.name")}) AND {q.strip("e.name")} <> '', false) AS ok,
  len(list_filter(coalesce(e.aliases, []), lambda a: a IS NOT NULL AND a <> '' AND coalesce(contains(p.text, a), false))) AS k FROM new_entities e LEFT JOIN pack_text p ON p.book = e.book AND p.pack = e.pack)
SELECT book, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected, CAST(coalesce(sum(k) FILTER (WHERE ok), 0) AS BIGINT) AS aliases FROM n GROUP BY book""")
def grounding_filter(s, d):
    e = table(s, d, "new_entities").join(validate.pack_texts(table(s, d, "relations")), ["book", "pack"], "left")
    name = strip_all(F.col("name"))
    ok = F.coalesce(F.contains(F.col("text"), name) & (name != ""), F.lit(False))
    k = F.coalesce(F.size(F.filter("aliases", lambda a: a.isNotNull() & (a != "") & F.coalesce(F.contains(F.col("text"), a), F.lit(False)))), F.lit(0))
    e = e.select("book", ok.alias("ok"), k.alias("k"))
    return e.groupBy("book").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"), F.sum(F.when(F.col("ok"), F.col("k")).otherwise(0)).alias("aliases"))


@query(f"""WITH schema_lines AS (SELECT string_agg(line, chr(10) ORDER BY line) AS x FROM ({ORACLE["schema_describe"]}) a), names AS (SELECT book, string_agg(line, chr(10) ORDER BY rank) AS x FROM ({ORACLE["registry_topn"]}) b GROUP BY book),
bodies AS (SELECT * FROM ({_PACK_BODY}) c)
SELECT p.book, p.pack_id, length(s.x || chr(10) || chr(10) || coalesce(n.x, '') || chr(10) || chr(10) || p.label || chr(10) || chr(10) || p.text) AS chars, md5(s.x || chr(10) || chr(10) || coalesce(n.x, '') || chr(10) || chr(10) || p.label || chr(10) || chr(10) || p.text) AS digest
FROM bodies p LEFT JOIN names n USING (book), schema_lines s""")
def extraction_prompts(s, d):
    p = extract.prompts(_packs(s, d), schema_describe(s, d), registry_topn(s, d))
    return p.select("book", "pack_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("digest"))


_FULL = f"""{_SURNAMES}, c AS (SELECT book, {q.strip("name")} AS name, freq FROM candidate WHERE book IS NOT NULL),
full0 AS (SELECT book, canon AS f FROM entity WHERE type = '人物' UNION SELECT book, name FROM c WHERE freq >= 1 GROUP BY book, name HAVING sum(freq) >= 2),
full1 AS (SELECT book, f, {_surname("f")} AS s FROM full0 WHERE regexp_matches(f, '^[一-龥]{{3,4}}$')),
full2 AS (SELECT book, f, substring(f, length(s) + 1) AS name FROM full1 WHERE s IS NOT NULL),
said AS (SELECT DISTINCT book, {q.strip("head")} AS name FROM relations UNION SELECT book, {q.strip("tail")} FROM relations),
j AS (SELECT n.book, n.name, x.f AS "full", count(*) OVER (PARTITION BY n.book, n.name) AS options FROM (SELECT book, name FROM said WHERE regexp_matches(name, '^[一-龥]{{2}}$')) n JOIN full2 x ON x.book = n.book AND x.name = n.name)"""


def _said(s, d):
    r = table(s, d, "relations")
    return r.select("book", F.explode(F.array("head", "tail")).alias("name")).select("book", strip_all(F.col("name")).alias("name")).distinct()


@query(f'WITH {_FULL} SELECT book, name, "full" FROM j WHERE options = 1')
def fullname_merge(s, d):
    return registry.full_names(_said(s, d), table(s, d, "candidate"), table(s, d, "entity")).where("options = 1").select("book", "name", "full")


@query(f'WITH {_FULL} SELECT book, name, "full", options FROM j WHERE options > 1')
def fullname_ambiguous(s, d):
    return registry.full_names(_said(s, d), table(s, d, "candidate"), table(s, d, "entity")).where("options > 1").select("book", "name", "full", "options")


@query(f"""
WITH n0 AS (SELECT book, type, name FROM new_entities WHERE book IS NOT NULL AND type IS NOT NULL UNION SELECT book, type, {q.strip("a")} FROM (SELECT book, type, unnest(aliases) AS a FROM new_entities WHERE book IS NOT NULL AND type IS NOT NULL) x),
n AS (SELECT DISTINCT book, type, name FROM n0 WHERE name <> '')
SELECT a.book, a.type, a.name AS short, b.name AS long FROM n a JOIN n b ON a.book = b.book AND a.type = b.type AND length(a.name) < length(b.name) AND (prefix(b.name, a.name) OR suffix(b.name, a.name))""")
def affix_pairs(s, d):
    e = table(s, d, "new_entities").where("book is not null and type is not null")
    n = e.select("book", "type", "name").unionAll(e.select("book", "type", F.explode("aliases").alias("a")).select("book", "type", strip_all(F.col("a")).alias("name")))
    return registry.affix_pairs(n.where("name <> ''")).distinct()


_PACK_GROUPS = "pack_groups AS (SELECT min(entry_id) AS group_id, book, list(name ORDER BY entry_id) AS members FROM new_entities WHERE book IS NOT NULL AND name IS NOT NULL GROUP BY book, pack)"


@query(f"""
WITH {q.ALIAS}, {_PACK_GROUPS}, m AS (SELECT group_id, book, pos, {q.strip("m")} AS m FROM (SELECT group_id, book, unnest(members) AS m, generate_subscripts(members, 1) AS pos FROM pack_groups) x WHERE m IS NOT NULL),
r AS (SELECT m.group_id, m.book, m.pos, a.canon, a.type FROM m JOIN alias a ON a.book = m.book AND a.name = m.m),
k AS (SELECT group_id, book, arg_min(canon, pos) AS keep, arg_min(type, pos) AS kt FROM r GROUP BY 1, 2)
SELECT DISTINCT r.group_id, r.book, r.canon AS "drop", k.keep FROM r JOIN k USING (group_id, book) WHERE r.canon <> k.keep AND r.type = k.kt""")
def merge_groups_apply(s, d):
    """Groups as a model would name them: the names reported of one pack, in order."""
    e = table(s, d, "new_entities").where("book is not null and name is not null")
    g = e.groupBy("book", "pack").agg(F.min("entry_id").alias("group_id"), F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "name"))), lambda x: x["name"]).alias("members"))
    return registry.merge_groups(g, _alias(s, d))


_LAST = "lastmap AS (SELECT book, alias, arg_max(canon, map_id) AS canon FROM merge_map WHERE book IS NOT NULL AND alias <> '' AND canon <> '' AND alias <> canon GROUP BY book, alias)"


@query(f"WITH {_LAST} SELECT * FROM lastmap")
def merge_map_build(s, d):
    return registry.last_wins(table(s, d, "merge_map").where("book is not null"))


# Extraction guards --------------------------------------------------------------------------------------------------------------

_E = f"coalesce({q.strip('evidence')}, '')"


def _relations(s, d):
    return table(s, d, "relations")


_NOT_NULL = "(head, relation, tail)"


@query(f"""
WITH {q.PACK}, g AS (SELECT book, pack, count(DISTINCT {_NOT_NULL}) AS triples FROM relations GROUP BY book, pack)
SELECT g.book, g.pack, triples, length(p.text) AS chars, round(triples / greatest(length(p.text), 1) * 1000, 4) AS density, triples / greatest(length(p.text), 1) * 1000 < 20 AND length(p.text) >= 300 AS low
FROM g JOIN pack_text p ON p.book = g.book AND p.pack = g.pack""")
def low_yield_packs(s, d):
    return extract.pack_yield(_relations(s, d), validate.pack_texts(_relations(s, d)), 20, 300)


@query(f"""SELECT response_id, count(*) AS n, count(DISTINCT {_NOT_NULL}) AS triples, count(DISTINCT {_E}) AS texts FROM relations GROUP BY response_id
HAVING count(*) >= 30 AND (count(*) > 3 * count(DISTINCT {_NOT_NULL}) OR count(*) > 3 * count(DISTINCT {_E}))""")
def loop_packs(s, d):
    return extract.loops(_relations(s, d))


def _later(key: str) -> str:
    return f"""
WITH r AS (SELECT assertion_id, round, book, pack, coalesce(head, chr(1)) AS h, coalesce(relation, chr(1)) AS rel, coalesce(tail, chr(1)) AS t, {_E} AS e FROM relations)
SELECT assertion_id, round FROM r WHERE round = 1
UNION ALL SELECT assertion_id, round FROM (SELECT * FROM r WHERE round > 1 AND NOT EXISTS (SELECT 1 FROM r o WHERE o.round = 1 AND o.book = r.book AND o.pack = r.pack AND o.h = r.h AND o.rel = r.rel AND o.t = r.t{" AND o.e = r.e" * (key == "e")})) x
QUALIFY row_number() OVER (PARTITION BY book, pack, h, rel, t{", e" * (key == "e")} ORDER BY assertion_id) = 1"""


@query(_later(""))
def second_read_union(s, d):
    return extract.later_rounds(_relations(s, d), False).select("assertion_id", "round")


@query(_later("e"))
def gleaning_union(s, d):
    return extract.later_rounds(_relations(s, d), True).select("assertion_id", "round")


@query(f"SELECT min(assertion_id) AS assertion_id FROM relations GROUP BY book, pack, head, relation, tail, {_E}")
def assertion_dedup(s, d):
    return extract.dedup(_relations(s, d))


@query(f"""SELECT assertion_id FROM relations r WHERE NOT (round = 1 AND response_id IN (SELECT response_id FROM relations WHERE round = 1 GROUP BY response_id HAVING count(*) >= 10 AND count(*) > 2 * count(DISTINCT {_E})))""")
def gleaning_loop_guard(s, d):
    """The rounds change places here: runaway responses stand in the first one."""
    return extract.drop_looping_gleanings(_relations(s, d).withColumn("round", 3 - F.col("round")), 10, 2).select("assertion_id")


# Validation ---------------------------------------------------------------------------------------------------------------------


def _checked(s, d):
    return validate.check(_relations(s, d), table(s, d, "entity"), table(s, d, "relation_spec"))


def _validated(s, d):
    return validate.validate(_relations(s, d), table(s, d, "entity"), table(s, d, "relation_spec"))


def _quoted(s, d):
    return validate.quote_checks(_checked(s, d), validate.pack_texts(_relations(s, d)), registry.name_forms(_alias(s, d)))


@query(f"WITH {q.VALIDATED} SELECT assertion_id, h AS head, r AS relation, t AS tail, evidence, evidence_src, flipped, why AS reason FROM validated")
def validate_assertions(s, d):
    return _validated(s, d).select("assertion_id", F.col("h").alias("head"), F.col("r").alias("relation"), F.col("t").alias("tail"), "evidence", "evidence_src", "flipped", F.col("why").alias("reason"))


@query(f"WITH {q.VALIDATED} SELECT assertion_id, h AS head, t AS tail, r AS relation FROM checked WHERE flipped")
def flip_direction(s, d):
    return _checked(s, d).where("flipped").select("assertion_id", F.col("h").alias("head"), F.col("t").alias("tail"), F.col("r").alias("relation"))


@query(f"WITH {q.VALIDATED} SELECT assertion_id, grounded FROM quoted")
def evidence_grounding(s, d):
    return _quoted(s, d).where("reason is null").select("assertion_id", "grounded")


@query(f"WITH {q.VALIDATED} SELECT assertion_id, both_named FROM quoted")
def co_mention(s, d):
    return _quoted(s, d).where("reason is null").select("assertion_id", "both_named")


@query(f"WITH {q.VALIDATED} SELECT assertion_id, s AS evidence FROM searched")
def evidence_window_search(s, d):
    return validate.search(_quoted(s, d), validate.sentence_windows(validate.pack_texts(_relations(s, d)))).select("assertion_id", F.col("s").alias("evidence"))


@query(f"WITH {q.VALIDATED} SELECT split_part(why, ':', 1) AS reason, count(*) AS n FROM validated WHERE why IS NOT NULL GROUP BY 1")
def drop_reasons(s, d):
    return _validated(s, d).where("why is not null").groupBy(F.substring_index("why", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {q.VALIDATED} SELECT v.book, count(*) AS raw, round(avg(CASE WHEN q.grounded THEN 1.0 ELSE 0 END), 4) AS exact, round(avg(CASE WHEN q.both_named THEN 1.0 ELSE 0 END), 4) AS named,
round(avg(CASE WHEN v.h IS NOT NULL AND v.t IS NOT NULL THEN 1.0 ELSE 0 END), 4) AS resolvable, round(avg(CASE WHEN v.why IS NULL THEN 1.0 ELSE 0 END), 4) AS passed
FROM validated v LEFT JOIN quoted q USING (assertion_id) GROUP BY v.book""")
def probe_metrics(s, d):
    v = _validated(s, d)
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return v.groupBy("book").agg(F.count("*").alias("raw"), rate(F.col("grounded")).alias("exact"), rate(F.col("both_named")).alias("named"), rate(F.col("h").isNotNull() & F.col("t").isNotNull()).alias("resolvable"), rate(F.col("why").isNull()).alias("passed"))


@query(f"""
WITH {q.VALIDATED}, {q.votes("round = 1", "a")}, {q.votes("round = 2", "b")}
SELECT 'both' AS part, count(*) AS n FROM (SELECT book, head, relation, tail FROM a INTERSECT SELECT book, head, relation, tail FROM b) x
UNION ALL SELECT 'first', count(*) FROM (SELECT book, head, relation, tail FROM a EXCEPT SELECT book, head, relation, tail FROM b) x
UNION ALL SELECT 'second', count(*) FROM (SELECT book, head, relation, tail FROM b EXCEPT SELECT book, head, relation, tail FROM a) x""")
def run_overlap(s, d):
    rows = aggregate.canonical(_validated(s, d))
    side = rows.groupBy(*aggregate.KEY).agg(F.max(F.col("round") == 1).alias("a"), F.max(F.col("round") == 2).alias("b"))
    n = side.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first"), F.count_if(F.col("b") & ~F.col("a")).alias("second"))
    return n.select(F.expr("stack(3, 'both', both, 'first', first, 'second', second) as (part, n)"))


# Aggregation and repair ---------------------------------------------------------------------------------------------------------


def _edges(s, d, where: str = "true"):
    return aggregate.aggregate(aggregate.canonical(_validated(s, d)).where(where))


_K = "book, head, relation, tail"
_CAND = f"WITH RECURSIVE {q.VALIDATED}, {q.votes()}"
_TEXT = _CAND


@query(f"{_CAND} SELECT {_K}, votes, mentions, packs FROM cand")
def vote_aggregate(s, d):
    return _edges(s, d).select(*aggregate.KEY, "votes", "mentions", "packs")


@query(f"{_CAND} SELECT {_K}, evidence, evidence_src, evidences FROM cand")
def best_evidence(s, d):
    return _edges(s, d).select(*aggregate.KEY, "evidence", "evidence_src", F.array_join("evidences", " | ").alias("evidences"))


@query(f"{_CAND}, c AS (SELECT DISTINCT {_K}, unnest(chapters) AS c FROM cand_rows) SELECT {_K}, string_agg(c, ',' ORDER BY c) AS chapters FROM c WHERE c IS NOT NULL GROUP BY {_K}")
def edge_chapters(s, d):
    c = aggregate.edge_chapters(aggregate.canonical(_validated(s, d)))
    return c.select(*aggregate.KEY, F.array_join("chapters", ",").alias("chapters")).where("chapters <> ''")


_FUNCTIONAL = """fun AS (SELECT c.*, s.func_group, CASE WHEN s.functional_on = 'tail' THEN c.tail ELSE c.head END AS anchor FROM cand c JOIN spec s ON s.name = c.relation WHERE s.functional_on IS NOT NULL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY book, func_group, anchor) AS claims, row_number() OVER (PARTITION BY book, func_group, anchor ORDER BY votes DESC, seq) AS place FROM fun)"""


@query(f"{_CAND}, {_FUNCTIONAL} SELECT book, func_group, anchor, head, relation, tail, votes, claims FROM ranked WHERE claims > 1")
def functional_conflicts(s, d):
    return aggregate.functional(_edges(s, d), table(s, d, "relation_spec")).where("claims > 1").select("book", "func_group", "anchor", "head", "relation", "tail", "votes", "claims")


@query(f"{_CAND}, {_FUNCTIONAL} SELECT {_K}, votes FROM cand c WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE place > 1 AND r.book = c.book AND r.head = c.head AND r.relation = c.relation AND r.tail = c.tail)")
def functional_resolve(s, d):
    return aggregate.resolve_functional(_edges(s, d), table(s, d, "relation_spec")).select(*aggregate.KEY, "votes")


@query(f"{_CAND}, cur AS (SELECT DISTINCT {_K} FROM cand_rows JOIN relations USING (assertion_id, book) WHERE confidence = 'low') SELECT {_K}, votes FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cur r WHERE r.book = c.book AND r.head = c.head AND r.relation = c.relation AND r.tail = c.tail)".replace("SELECT DISTINCT book, head, relation, tail FROM cand_rows JOIN relations USING (assertion_id, book)", "SELECT DISTINCT x.book, x.head, x.relation, x.tail FROM cand_rows x JOIN validated v ON v.assertion_id = x.assertion_id"))
def curation_anti(s, d):
    """Curated out: edges that any assertion states with low confidence."""
    rows = aggregate.canonical(_validated(s, d))
    return aggregate.aggregate(rows).join(rows.where("confidence = 'low'").select(*aggregate.KEY).distinct(), list(aggregate.KEY), "left_anti").select(*aggregate.KEY, "votes")


@query(f"""{_CAND}, {_LAST}, m AS (SELECT c.book, coalesce(a.canon, c.head) AS h, c.relation, coalesce(b.canon, c.tail) AS t, c.votes, c.mentions, c.seq, c.evidence, s.sym FROM cand c
LEFT JOIN lastmap a ON a.book = c.book AND a.alias = c.head LEFT JOIN lastmap b ON b.book = c.book AND b.alias = c.tail LEFT JOIN spec s ON s.name = c.relation)
SELECT book, CASE WHEN sym THEN least(h, t) ELSE h END AS head, relation, CASE WHEN sym THEN greatest(h, t) ELSE t END AS tail, CAST(sum(votes) AS BIGINT) AS votes, CAST(sum(mentions) AS BIGINT) AS mentions, arg_min(evidence, seq) AS evidence
FROM m WHERE h <> t GROUP BY 1, 2, 3, 4""")
def merge_map_remap(s, d):
    e = aggregate.remap(_edges(s, d), registry.last_wins(table(s, d, "merge_map").where("book is not null")), table(s, d, "relation_spec"))
    return e.select(*aggregate.KEY, "votes", "mentions", "evidence")


@query(f"""{_CAND} SELECT v.book, count(*) AS raw, count(*) FILTER (WHERE why IS NULL) AS valid, count(*) FILTER (WHERE why IS NOT NULL) AS dropped, any_value(e.n) AS edges
FROM validated v LEFT JOIN (SELECT book, count(*) AS n FROM cand GROUP BY book) e ON e.book = v.book GROUP BY v.book""")
def run_summary(s, d):
    v = _validated(s, d)
    e = aggregate.canonical(v).select(*aggregate.KEY).distinct().groupBy("book").agg(F.count("*").alias("edges"))
    return v.groupBy("book").agg(F.count("*").alias("raw"), F.count_if(F.col("why").isNull()).alias("valid"), F.count_if(F.col("why").isNotNull()).alias("dropped")).join(e, "book", "left")


# Review -------------------------------------------------------------------------------------------------------------------------
# Verdicts by a fixed rule on an edge's numbers n = (seq + 3 mentions + votes) % 10: 0 none, 1 approved against its own reason,
# 2 direction, 3 type, 4 contradiction by its reason only, 5 other, 6 no kind, else approved.

_VERDICT = """verdict AS (SELECT book, head, relation, tail, n NOT BETWEEN 2 AND 6 AS ok, CASE n WHEN 2 THEN '方向' WHEN 3 THEN '类型' WHEN 5 THEN '其他' END AS kind,
  CASE n WHEN 1 THEN '证 据不足，不能确定' WHEN 2 THEN '头尾反了' WHEN 4 THEN '有两个父亲' WHEN 6 THEN '' ELSE '成立' END AS reason FROM (SELECT *, (seq + 3 * mentions + votes) % 10 AS n FROM cand) x WHERE n > 0)"""

_GUARD = "WHEN why = '方向' AND NOT sym AND domain = tt AND range = ht THEN 'flip' WHEN votes >= 3 AND why NOT IN ('逻辑矛盾', '类型') THEN 'kept_votes' WHEN why = '' THEN 'kept_nokind'"


def _judged(guard: bool = True, name: str = "judged") -> str:
    return f"""{name}_0 AS (SELECT c.*, v.ok, v.reason, CASE WHEN trim(coalesce(v.kind, '')) IN ('方向', '类型', '证据不足', '逻辑矛盾', '其他') THEN trim(v.kind)
  WHEN contains(coalesce(v.reason, ''), '方向') OR (contains(coalesce(v.reason, ''), '应为') AND contains(coalesce(v.reason, ''), '→')) THEN '方向'
  WHEN regexp_matches(coalesce(v.reason, ''), '矛盾|两个父亲|并非|不是同一') THEN '逻辑矛盾' WHEN contains(coalesce(v.reason, ''), '证据') THEN '证据不足' ELSE '' END AS why,
  s.domain, s.range, s.sym, eh.type AS ht, et.type AS tt FROM cand c LEFT JOIN verdict v USING (book, head, relation, tail) LEFT JOIN spec s ON s.name = c.relation
  LEFT JOIN entity eh ON eh.book = c.book AND eh.canon = c.head LEFT JOIN entity et ON et.book = c.book AND et.canon = c.tail),
{name} AS (SELECT *, CASE WHEN ok IS NULL THEN 'unjudged' WHEN ok AND regexp_matches(replace(reason, ' ', ''), '{"|".join(review.NEGATIVE)}') THEN 'doubtful' WHEN ok THEN 'ok' {_GUARD if guard else ""} ELSE 'reject' END AS outcome FROM {name}_0)"""


_APPLIED = """turned AS (SELECT book, CASE WHEN outcome = 'flip' THEN tail ELSE head END AS head, relation, CASE WHEN outcome = 'flip' THEN head ELSE tail END AS tail, votes, mentions, seq, evidence, outcome, CASE WHEN outcome = 'flip' THEN 1 ELSE 0 END AS late
  FROM judged WHERE outcome <> 'reject'),
applied AS (SELECT book, head, relation, tail, CAST(sum(votes) AS BIGINT) AS votes, CAST(sum(mentions) AS BIGINT) AS mentions, min(seq) AS seq, arg_min(evidence, (late, seq)) AS evidence, arg_min(outcome, (late, seq)) AS outcome FROM turned GROUP BY 1, 2, 3, 4)"""


def _verdicts(edges: DataFrame) -> DataFrame:
    n = (F.col("seq") + 3 * F.col("mentions") + F.col("votes")) % 10
    pick = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col("n").cast("int"))
    v = edges.select(*aggregate.KEY, n.alias("n")).where("n > 0")
    return v.select(*aggregate.KEY, (~F.col("n").between(2, 6)).alias("ok"), pick({2: "方向", 3: "类型", 5: "其他"}).alias("kind"), F.coalesce(pick({1: "证 据不足，不能确定", 2: "头尾反了", 4: "有两个父亲", 6: ""}), F.lit("成立")).alias("reason"))


def _review(s, d, guarded=True, where="true"):
    e = cut(_edges(s, d, where))
    return review.outcomes(e, _verdicts(e), table(s, d, "entity"), table(s, d, "relation_spec"), guarded)


@query(f"{_CAND} SELECT book, entity, count(*) AS edges FROM (SELECT book, head AS entity FROM cand UNION ALL SELECT book, tail FROM cand WHERE head <> tail) x GROUP BY 1, 2")
def edges_by_entity(s, d):
    return review.by_entity(_edges(s, d)).groupBy("book", "entity").agg(F.count("*").alias("edges"))


@query(f"""{_CAND}, who AS (SELECT book, canon, CASE WHEN identity <> '' THEN '（' || identity || '）' ELSE '' END AS x FROM entity)
SELECT c.book, c.head, c.relation, c.tail, c.head || coalesce(h.x, '') || ' —' || c.relation || '→ ' || c.tail || coalesce(t.x, '') || ' [' || c.votes || '] ' || c.evidence AS line
FROM cand c LEFT JOIN who h ON h.book = c.book AND h.canon = c.head LEFT JOIN who t ON t.book = c.book AND t.canon = c.tail""")
def review_prompts(s, d):
    return review.prompt_rows(_edges(s, d), table(s, d, "entity"))


@query()
def review_batches(s, d):
    return review.batches(cut(_edges(s, d)))


@query(f"{_CAND}, {_VERDICT}, {_judged()} SELECT {_K} FROM judged WHERE outcome = 'doubtful'")
def doubtful_verdicts(s, d):
    return _review(s, d).where("outcome = 'doubtful'").select(*aggregate.KEY)


@query(f"{_CAND}, {_VERDICT}, {_judged()} SELECT {_K}, why FROM judged WHERE NOT ok")
def verdict_kind(s, d):
    return _review(s, d).where("not ok").select(*aggregate.KEY, "why")


@query(f"{_CAND}, {_VERDICT}, {_judged()} SELECT {_K}, outcome FROM judged")
def apply_verdicts(s, d):
    return _review(s, d).select(*aggregate.KEY, "outcome")


@query(f"{_CAND}, {_VERDICT}, {_judged()} SELECT outcome, count(*) AS n FROM judged GROUP BY outcome")
def review_stats(s, d):
    return _review(s, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"{_CAND}, {_VERDICT}, {_judged()}, {_APPLIED} SELECT {_K}, votes, mentions, evidence, outcome FROM applied")
def flip_merge(s, d):
    return review.apply(_review(s, d)).select(*aggregate.KEY, "votes", "mentions", "evidence", "outcome")


_ADDED = f"""prop AS (SELECT r.assertion_id AS id, r.book, a.canon AS h, b.canon AS t, {q.strip("r.relation")} AS relation, r.evidence AS reason FROM relations r
  JOIN alias a ON a.book = r.book AND a.name = {q.strip("r.head")} JOIN alias b ON b.book = r.book AND b.name = {q.strip("r.tail")}),
good AS (SELECT p.*, s.sym FROM prop p JOIN spec s ON s.name = p.relation JOIN entity x ON x.book = p.book AND x.canon = p.h JOIN entity y ON y.book = p.book AND y.canon = p.t
  JOIN forms fh ON fh.book = p.book AND fh.canon = p.h JOIN forms ft ON ft.book = p.book AND ft.canon = p.t
  WHERE p.h <> p.t AND s.domain = x.type AND s.range = y.type AND {q.mention("fh.names", "p.reason")} AND {q.mention("ft.names", "p.reason")}),
keyed AS (SELECT book, CASE WHEN sym THEN least(h, t) ELSE h END AS head, relation, CASE WHEN sym THEN greatest(h, t) ELSE t END AS tail, min(id) AS id, arg_min(reason, id) AS reason FROM good GROUP BY 1, 2, 3, 4),
added AS (SELECT k.* FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.book = k.book AND c.head = k.head AND c.relation = k.relation AND c.tail = k.tail))"""


def _text_edges(s, d):
    """The text layer of the graph queries: the edges of all rounds."""
    return _edges(s, d)


def _additions(s, d, edges):
    """Proposals: all assertions, their quotation as reason; those that no candidate has are additions."""
    p = _relations(s, d).select(F.col("assertion_id").alias("id"), "book", "head", strip_all(F.col("relation")).alias("relation"), "tail", F.col("evidence").alias("reason"))
    return review.additions(p, edges, table(s, d, "entity"), table(s, d, "relation_spec"))


@query(f"{_TEXT}, {_ADDED} SELECT {_K}, reason FROM added")
def additions_filter(s, d, of=_text_edges):
    return _additions(s, d, cut(of(s, d))).select(*aggregate.KEY, "reason")


# Inference ----------------------------------------------------------------------------------------------------------------------

_SYMMETRIC = ["夫妻", "结拜", "同窗", "姻亲", "敌对", *infer.DERIVED_SYMMETRIC]


def _rules_sql(rules, rounds: int) -> str:
    """The rounds unrolled as common tables over ``cand``; the last is ``inferred``."""
    sym = "(" + ", ".join(f"'{x}'" for x in _SYMMETRIC) + ")"
    quoted = lambda names: "(" + ", ".join(f"'{x}'" for x in names.split("|")) + ")"
    out = [f"facts_0 AS (SELECT {_K}, CAST(votes AS BIGINT) AS votes FROM cand)"]
    made = []
    for n in range(1, rounds + 1):
        out.append(f"snap_{n} AS (SELECT {_K}, votes FROM facts_{n - 1} UNION SELECT book, tail, relation, head, votes FROM facts_{n - 1} WHERE relation IN {sym})")
        fresh: list[str] = []
        for i, r in enumerate(rules):
            where, value = [], {}
            tabs = []
            for k, (h, rel, t) in enumerate(r.premises):
                src = f"snap_{n}"
                if r.dominant is not None and rel == r.premises[r.dominant][1]:
                    src = f"(SELECT * FROM snap_{n} WHERE relation IN {quoted(rel)} QUALIFY row_number() OVER (PARTITION BY book, head, relation ORDER BY votes DESC, tail) = 1)"
                tabs.append(f"{src} p{k}")
                where.append(f"p{k}.relation IN {quoted(rel)}")
                if k:
                    where.append(f"p{k}.book = p0.book")
                for x, c in ((h, "head"), (t, "tail")):
                    if not x.startswith("?"):
                        where.append(f"p{k}.{c} = '{x}'")
                    elif x in value:
                        where.append(f"{value[x]} = p{k}.{c}")
                    else:
                        value[x] = f"p{k}.{c}"
            val = lambda x: value[x] if x.startswith("?") else f"'{x}'"  # noqa: B023, E731
            h, rel, t = r.then
            support = " || '; ' || ".join(f"{val(a)} || ' {p} ' || {val(b)}" for a, p, b in r.premises)
            where.append(f"{val(h)} <> {val(t)}")
            known = f"SELECT {_K} FROM snap_{n}" + "".join(f" UNION ALL SELECT {_K} FROM {f} UNION ALL SELECT book, tail, relation, head FROM {f} WHERE relation IN {sym}" for f in fresh)
            if r.unless_head_has:
                where.append(f"NOT EXISTS (SELECT 1 FROM facts_0 z WHERE z.relation = '{r.unless_head_has}' AND z.book = p0.book AND z.head = {val(h)})")
            if r.unless:
                where.append(f"NOT EXISTS (SELECT 1 FROM ({known}) z WHERE z.relation IN {quoted(r.unless[1])} AND z.book = p0.book AND z.head = {val(r.unless[0])} AND z.tail = {val(r.unless[2])})")
            two = rel in _SYMMETRIC
            key = f"p0.book AS book, {'least' if two else ''}({val(h)}{', ' + val(t) if two else ''}) AS head, '{rel}' AS relation, {'greatest(' + val(h) + ', ' if two else '('}{val(t)}) AS tail"
            name = f"new_{n}_{i}"
            out.append(f"{name} AS (SELECT {_K}, min(support) AS support, '{r.name}' AS rule, {n} AS round FROM (SELECT {key}, {support} AS support FROM {', '.join(tabs)} WHERE {' AND '.join(where)}) x WHERE NOT EXISTS (SELECT 1 FROM ({known}) z WHERE z.book = x.book AND z.head = x.head AND z.relation = x.relation AND z.tail = x.tail) GROUP BY {_K})")
            fresh.append(name)
        made += fresh
        out.append(f"facts_{n} AS (SELECT * FROM facts_{n - 1}" + "".join(f" UNION ALL SELECT {_K}, 1 FROM {f}" for f in fresh) + ")")
    out.append("inferred AS (" + " UNION ALL ".join(f"SELECT * FROM {m}" for m in made) + ")")
    return ", ".join(out)


@query(f"{_TEXT} SELECT {_K} FROM cand UNION SELECT book, tail, relation, head FROM cand WHERE relation IN ('夫妻', '结拜', '同窗', '姻亲', '敌对')")
def edges_closure_sym(s, d, of=_text_edges):
    return infer.both_ways(of(s, d).select(*aggregate.KEY), _SYMMETRIC)


def _one_rule(name: str, key: str, rule: infer.Rule):
    def run(s, d, of=_text_edges):
        return infer.infer(of(s, d), _SYMMETRIC, (rule,), 1).select(*aggregate.KEY, "support")

    run.__name__ = name
    query(f"{_TEXT}, {_rules_sql((rule,), 1)} SELECT {_K}, support FROM inferred")(run)


_BY_NAME = {r.name: r for r in infer.RULES}
_one_rule("rule_two_hop", "two", _BY_NAME["house of the spouse"])
_one_rule("rule_three_hop", "three", infer.Rule("friends of pupils", (("?x", "师徒", "?a"), ("?x", "结拜|敌对", "?y"), ("?y", "师徒", "?b")), ("?a", "世交", "?b")))
_one_rule("rule_dominant", "dominant", _BY_NAME["side of the master"])
_one_rule("rule_sibling", "sibling", _BY_NAME["fellow pupils"])
_one_rule("rule_grandparent", "grandparent", _BY_NAME["grandmother"])
_one_rule("rule_cousin_unless", "cousin", _BY_NAME["family friends"])


@query(f"{_TEXT}, {_rules_sql(infer.RULES, 3)} SELECT {_K}, rule, support, CAST(round AS INTEGER) AS round FROM inferred")
def infer_fixpoint(s, d, of=_text_edges):
    return infer.infer(of(s, d), _SYMMETRIC)


# The graph of the SQL: the validated edges of all rounds, additions, three rounds of inference ---------------------------------------
# The reviewed, merged and repaired graph is that of the whole_ queries at the end.

_TRIPLES = f"""{_ADDED}, {_rules_sql(infer.RULES, 3)},
triples AS (SELECT {_K}, CAST(votes AS BIGINT) AS votes, 'text' AS source, evidence FROM cand UNION ALL SELECT {_K}, 0, 'model', NULL FROM added UNION ALL SELECT {_K}, NULL, 'inferred', NULL FROM inferred)"""
_GRAPH = f"{_TEXT}, {_TRIPLES}"


def _triples(s, d):
    text = cut(_text_edges(s, d))
    none = F.lit(None).cast("string").alias("evidence")
    t = text.select(*aggregate.KEY, F.col("votes").cast("long").alias("votes"), F.lit(graph.TEXT).alias("source"), "evidence")
    m = _additions(s, d, text).select(*aggregate.KEY, F.lit(0).cast("long").alias("votes"), F.lit(graph.MODEL).alias("source"), none)
    i = infer.infer(text, _SYMMETRIC).select(*aggregate.KEY, F.lit(None).cast("long").alias("votes"), F.lit(graph.INFERRED).alias("source"), none)
    return t.unionByName(m).unionByName(i)


@query(f"{_GRAPH} SELECT {_K}, votes, source, evidence FROM triples")
def export_triples(s, d, of=_triples):
    return files.export(of(s, d))


# Evaluation ---------------------------------------------------------------------------------------------------------------------
# Gold: the book's assertions with high confidence that the model quoted, as stated (a bag); a gold name's other forms are the aliases reported of it.

_GOLD = f"""gold AS (SELECT assertion_id AS gold_id, book, {q.strip("head")} AS head, {q.strip("relation")} AS relation, {q.strip("tail")} AS tail FROM relations
  WHERE lower({q.strip("confidence")}) = 'high' AND {q.strip("evidence_src")} = '模型引用' AND head IS NOT NULL AND relation IS NOT NULL AND tail IS NOT NULL),
gold_alias AS (SELECT DISTINCT book, name, form FROM (SELECT book, name, {q.strip("a")} AS form FROM (SELECT book, name, unnest(aliases) AS a FROM new_entities) x) y WHERE form <> '')"""

_RESOLVED = f"""{_SURNAMES}, gn AS (SELECT DISTINCT book, name FROM (SELECT book, head AS name FROM gold UNION ALL SELECT book, tail FROM gold UNION ALL SELECT book, form FROM gold_alias) x),
tries AS (SELECT *, regexp_matches(name, '^[^（]*（.*）$') AS br FROM gn),
resolved AS (SELECT t.book, t.name, coalesce(a0.canon, a1.canon, a2.canon, a3.canon, t.name) AS resolved FROM tries t LEFT JOIN alias a0 ON a0.book = t.book AND a0.name = t.name
  LEFT JOIN alias a1 ON a1.book = t.book AND t.br AND a1.name = regexp_extract(t.name, '^[^（]*（(.*)）$', 1) LEFT JOIN alias a2 ON a2.book = t.book AND t.br AND a2.name = regexp_extract(t.name, '^([^（]*)（', 1)
  LEFT JOIN alias a3 ON a3.book = t.book AND length(t.name) >= 3 AND substring(t.name, 1, 1) IN (SELECT surname FROM surnames WHERE length(surname) = 1) AND a3.name = substring(t.name, 2))"""

_VARIANTS = """gf0 AS (SELECT book, name, name AS form FROM (SELECT book, head AS name FROM gold UNION SELECT book, tail FROM gold) x
  UNION SELECT a.book, a.name, a.form FROM gold_alias a JOIN (SELECT book, head AS name FROM gold UNION SELECT book, tail FROM gold) n ON n.book = a.book AND n.name = a.name),
gf AS (SELECT * FROM gf0 UNION SELECT g.book, g.name, r.resolved FROM gf0 g JOIN resolved r ON r.book = g.book AND r.name = g.form),
variants AS (SELECT DISTINCT g.gold_id, g.book, CASE WHEN s.sym THEN least(a.form, b.form) ELSE a.form END AS head, g.relation, CASE WHEN s.sym THEN greatest(a.form, b.form) ELSE b.form END AS tail
  FROM gold g JOIN gf a ON a.book = g.book AND a.name = g.head JOIN gf b ON b.book = g.book AND b.name = g.tail LEFT JOIN spec s ON s.name = g.relation)"""

_EVAL = f"{_GRAPH}, {_GOLD}, {_RESOLVED}, {_VARIANTS}, judged_gold AS (SELECT g.*, EXISTS (SELECT 1 FROM variants v JOIN triples t USING (book, head, relation, tail) WHERE v.gold_id = g.gold_id) AS hit FROM gold g)"


def _gold(s, d):
    r = _relations(s, d).where((F.lower(strip_all(F.col("confidence"))) == "high") & (strip_all(F.col("evidence_src")) == "模型引用") & F.expr("head is not null and relation is not null and tail is not null"))
    return r.select(F.col("assertion_id").alias("gold_id"), "book", *(strip_all(F.col(c)).alias(c) for c in ("head", "relation", "tail")))


def _gold_alias(s, d):
    a = table(s, d, "new_entities").select("book", "name", F.explode("aliases").alias("a"))
    return a.select("book", "name", strip_all(F.col("a")).alias("form")).where("form <> ''").distinct()


def _gold_resolved(s, d):
    g = _gold(s, d)
    n = g.select("book", F.explode(F.array("head", "tail")).alias("name")).unionAll(_gold_alias(s, d).select("book", F.col("form").alias("name")))
    return evaluate.gold_resolve(n, _alias(s, d), registry.surnames(table(s, d, "entity")))


def _gold_variants(s, d):
    return evaluate.variants(_gold(s, d), _gold_alias(s, d), _gold_resolved(s, d), table(s, d, "relation_spec"))


@query(f"WITH {_GOLD} SELECT * FROM gold")
def gold_load(s, d):
    return _gold(s, d)


@query(f"WITH {q.ALIAS}, {_GOLD}, {_RESOLVED} SELECT book, name, resolved FROM resolved")
def gold_resolve(s, d):
    return _gold_resolved(s, d)


@query(f"WITH {q.ALIAS}, {q.SPEC}, {_GOLD}, {_RESOLVED}, {_VARIANTS} SELECT gold_id, {_K} FROM variants")
def gold_variants(s, d):
    return _gold_variants(s, d)


def _layer_sql(name: str, sources: str) -> str:
    return f"""SELECT '{name}' AS layers, pred, gold, hit, round(coalesce(tp / nullif(pred, 0), 0), 4) AS "precision", round(coalesce(hit / nullif(gold, 0), 0), 4) AS recall,
round(coalesce(2 * coalesce(tp / nullif(pred, 0), 0) * coalesce(hit / nullif(gold, 0), 0) / nullif(coalesce(tp / nullif(pred, 0), 0) + coalesce(hit / nullif(gold, 0), 0), 0), 0), 4) AS f1 FROM
(SELECT (SELECT count(*) FROM (SELECT DISTINCT {_K} FROM triples WHERE source IN ({sources})) x) AS pred, (SELECT count(*) FROM gold) AS gold,
 (SELECT count(DISTINCT v.gold_id) FROM variants v JOIN triples t USING (book, head, relation, tail) WHERE t.source IN ({sources})) AS hit,
 (SELECT count(*) FROM (SELECT DISTINCT {_K} FROM triples t JOIN variants v USING (book, head, relation, tail) WHERE t.source IN ({sources})) y) AS tp) z"""


_LAYERS = {"text": ("text",), "text+model": ("text", "model"), "all": ("text", "model", "inferred")}


@query(_EVAL + " " + " UNION ALL ".join(_layer_sql(n, ", ".join(f"'{x}'" for x in xs)) for n, xs in _LAYERS.items()))
def eval_layers(s, d, of=_triples):
    return evaluate.layer_scores(_gold(s, d), cut(_gold_variants(s, d)), cut(of(s, d)), _LAYERS)


def _judged_gold(s, d, of=_triples):
    return evaluate.hits(_gold(s, d), _gold_variants(s, d), of(s, d))


@query(f"{_EVAL} SELECT relation, count(*) FILTER (WHERE hit) AS hit, count(*) AS total FROM judged_gold GROUP BY ROLLUP (relation)")
def eval_by_relation(s, d, of=_triples):
    return evaluate.by_relation(_judged_gold(s, d, of))


@query(f"{_EVAL} SELECT gold_id, {_K} FROM judged_gold WHERE NOT hit ORDER BY book, head, relation, tail, gold_id LIMIT 40")
def eval_missed(s, d, of=_triples):
    return _judged_gold(s, d, of).where("not hit").orderBy(*aggregate.KEY, "gold_id").limit(40).select("gold_id", *aggregate.KEY)


@query(f"{_EVAL} SELECT DISTINCT {_K} FROM triples t WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.book = t.book AND v.head = t.head AND v.relation = t.relation AND v.tail = t.tail) ORDER BY book, head, relation, tail LIMIT 40")
def eval_extra(s, d, of=_triples):
    return of(s, d).select(*aggregate.KEY).distinct().join(_gold_variants(s, d).select(*aggregate.KEY).distinct(), list(aggregate.KEY), "left_anti").orderBy(*aggregate.KEY).limit(40)


@query(f"{_TEXT} SELECT {_K}, evidence FROM cand ORDER BY md5('7' || book || '|' || head || '|' || relation || '|' || tail) LIMIT 50")
def human_sample(s, d, of=_text_edges):
    key = F.concat_ws("|", *aggregate.KEY)
    return evaluate.sample(of(s, d), key, 50, "7").select(*aggregate.KEY, "evidence")


_W = "(p + 1.96 * 1.96 / (2 * n) {} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"


@query(f"{_EVAL}, a AS (SELECT relation, count(*) FILTER (WHERE hit) AS \"right\", count(*) AS judged FROM judged_gold GROUP BY relation) SELECT relation, \"right\", judged, round({_W.format('-')}, 4) AS low, round({_W.format('+')}, 4) AS high FROM (SELECT *, CAST(judged AS DOUBLE) AS n, \"right\" / judged AS p FROM a) x")
def audit_wilson(s, d, of=_triples):
    """Accuracy by relation, the hits standing for the judgements of an audit."""
    g = _judged_gold(s, d, of).groupBy("relation").agg(F.count_if("hit").alias("right"), F.count("*").alias("judged"))
    low, high = evaluate.wilson(F.col("right"), F.col("judged"))
    return g.select("relation", "right", "judged", low.alias("low"), high.alias("high"))


_ABLATION = " UNION ALL ".join(
    f"""SELECT '{n}' AS variant, (SELECT count(*) FROM {n}_kept) AS pred, (SELECT count(DISTINCT v.gold_id) FROM variants v JOIN {n}_kept k USING (book, head, relation, tail)) AS hit, (SELECT count(*) FROM gold) AS gold""" for n in ("guarded", "plain")
)


@query(f"{_TEXT}, {_VERDICT}, {_judged(True, 'g')}, {_judged(False, 'p')}, guarded_kept AS (SELECT DISTINCT book, CASE WHEN outcome = 'flip' THEN tail ELSE head END AS head, relation, CASE WHEN outcome = 'flip' THEN head ELSE tail END AS tail FROM g WHERE outcome <> 'reject'), plain_kept AS (SELECT {_K} FROM p WHERE outcome <> 'reject'), {_GOLD}, {_RESOLVED}, {_VARIANTS} {_ABLATION}")
def ablation_matrix(s, d, of=_text_edges):
    g, v = _gold(s, d), cut(_gold_variants(s, d))
    e = cut(of(s, d))
    out = None
    for n, guarded in (("guarded", True), ("plain", False)):
        p = cut(review.apply(review.outcomes(e, _verdicts(e), table(s, d, "entity"), table(s, d, "relation_spec"), guarded)))
        one = evaluate.scores(g, v, p, n).select(F.col("layers").alias("variant"), "pred", "hit", "gold")
        out = one if out is None else out.unionByName(one)
    return out


# Graph queries ------------------------------------------------------------------------------------------------------------------

_ENDS = "ends AS (SELECT book, head AS node, tail AS other, relation, '→' AS dir, votes, source FROM triples UNION ALL SELECT book, tail, head, relation, '←', votes, source FROM triples)"
_DEGREE = "degrees AS (SELECT book, node AS name, count(*) AS degree FROM ends GROUP BY 1, 2)"
_TOP = "tops AS (SELECT d.book, d.name, d.degree, row_number() OVER (PARTITION BY d.book ORDER BY d.degree DESC, d.name) AS rank FROM degrees d JOIN entity e ON e.book = d.book AND e.canon = d.name WHERE e.type = '人物')"
_FOCUS = "focus AS (SELECT book, name AS focus FROM tops WHERE rank = 1)"
_G = f"{_GRAPH}, {_ENDS}, {_DEGREE}, {_TOP}, {_FOCUS}"


def _focus(s, d, t):
    return graph.top_degree(t, table(s, d, "entity"), top=1).select("book", F.col("name").alias("focus"))


def _graph(s, d, of=_triples):
    """The triples, written once: the graph queries read them several times."""
    return cut(of(s, d))


@query(f"WITH {q.ALIAS}, {_GOLD}, x AS (SELECT g.book, g.form AS name, a.canon FROM gold_alias g JOIN alias a ON a.book = g.book AND a.name = g.name) SELECT book, name, min(canon) AS canon FROM (SELECT book, name, canon FROM alias UNION ALL SELECT x.book, x.name, x.canon FROM x WHERE NOT EXISTS (SELECT 1 FROM alias a WHERE a.book = x.book AND a.name = x.name)) y GROUP BY 1, 2")
def panel_alias(s, d):
    a = _alias(s, d).select("book", "name", "canon")
    more = _gold_alias(s, d).join(a, ["book", "name"]).select("book", F.col("form").alias("name"), "canon").join(a.select("book", "name"), ["book", "name"], "left_anti")
    return a.unionByName(more).groupBy("book", "name").agg(F.min("canon").alias("canon"))


@query(f"{_G} SELECT * FROM degrees")
def degree(s, d, of=_triples):
    return graph.degree(of(s, d))


@query(f"{_G} SELECT book, rank, name, degree, round(degree / max(degree) OVER (PARTITION BY book), 4) AS share FROM tops WHERE rank <= 8")
def top_degree(s, d, of=_triples):
    return graph.top_degree(of(s, d), table(s, d, "entity"))


@query(f"{_GRAPH} SELECT {_K}, votes, source FROM triples WHERE source <> 'inferred' AND (source <> 'text' OR coalesce(votes, 1) >= 2)")
def high_confidence_edges(s, d, of=_triples):
    return graph.shown(of(s, d)).select(*aggregate.KEY, "votes", "source")


@query(f"{_G}, near AS (SELECT book, focus AS name FROM focus UNION SELECT e.book, e.other FROM ends e JOIN focus f ON f.book = e.book AND f.focus = e.node) SELECT {_K}, source FROM triples t WHERE EXISTS (SELECT 1 FROM near n WHERE n.book = t.book AND n.name = t.head) AND EXISTS (SELECT 1 FROM near n WHERE n.book = t.book AND n.name = t.tail)")
def ego_network(s, d, of=_triples):
    t = _graph(s, d, of)
    return graph.ego(t, _focus(s, d, t)).select(*aggregate.KEY, "source")


def _lookup_sql(where: str, top: int) -> str:
    return f"""{_G}, hit AS (SELECT e.book, e.node AS focus, e.relation, e.other, max(coalesce(e.votes, 0)) AS votes FROM ends e JOIN focus f ON f.book = e.book AND f.focus = e.node WHERE {where} GROUP BY 1, 2, 3, 4)
SELECT book, focus, row_number() OVER (PARTITION BY book ORDER BY votes DESC, relation, other) AS rank, relation, other, votes FROM hit QUALIFY rank <= {top}"""


@query(_lookup_sql("e.relation IN ('居住', '驻守')", 15))
def relation_lookup(s, d, of=_triples):
    t = _graph(s, d, of)
    return graph.lookup(t, _focus(s, d, t), graph.expand_word("住在", list(CATEGORY), SYNONYMS))


@query(_lookup_sql("true", 60))
def entity_detail(s, d, of=_triples):
    t = _graph(s, d, of)
    return graph.lookup(t, _focus(s, d, t), top=60)


@query(f"WITH {q.ALIAS} SELECT book, row_number() OVER (PARTITION BY book ORDER BY (name = canon) DESC, canon, name) AS rank, name AS label, canon FROM alias WHERE contains(name, '云') QUALIFY rank <= 12")
def suggest(s, d):
    return graph.suggest(_alias(s, d), "云")


_BFS = """bfs AS (SELECT book, focus AS node, 0 AS hops FROM focus UNION SELECT e.book, e.other, b.hops + 1 FROM bfs b JOIN ends e ON e.book = b.book AND e.node = b.node WHERE b.hops < 30 AND e.source <> 'inferred'),
dist AS (SELECT book, node, min(hops) AS hops FROM bfs GROUP BY 1, 2)"""


@query(f"{_G}, {_BFS} SELECT book, node, hops FROM dist")
def bfs_distances(s, d, of=_triples):
    t = _graph(s, d, of)
    return graph.distances(t, _focus(s, d, t).select("book", F.col("focus").alias("node")))


@query(f"""{_G}, {_BFS}, target AS (SELECT book, node, hops FROM dist QUALIFY row_number() OVER (PARTITION BY book ORDER BY hops DESC, node) = 1),
edge AS (SELECT book, node, other, arg_min(relation, (relation, dir)) AS relation, arg_min(dir, (relation, dir)) AS dir FROM ends WHERE source <> 'inferred' GROUP BY 1, 2, 3),
par AS (SELECT e.book, e.other AS node, e.node AS parent, e.relation, e.dir FROM edge e JOIN dist a ON a.book = e.book AND a.node = e.other JOIN dist b ON b.book = e.book AND b.node = e.node WHERE b.hops = a.hops - 1
  QUALIFY row_number() OVER (PARTITION BY e.book, e.other ORDER BY e.node) = 1),
path AS (SELECT t.book, t.hops AS step, t.node FROM target t UNION ALL SELECT p.book, x.step - 1, p.parent FROM path x JOIN par p ON p.book = x.book AND p.node = x.node)
SELECT x.book, x.step, x.node, coalesce(p.relation, '') AS relation, coalesce(p.dir, '') AS dir FROM path x LEFT JOIN par p ON p.book = x.book AND p.node = x.node""")
def shortest_path(s, d, of=_triples):
    """From each book's busiest person to the farthest node."""
    t = _graph(s, d, of)
    f = _focus(s, d, t)
    far = graph.distances(t, f.select("book", F.col("focus").alias("node")))
    far = far.groupBy("book").agg(F.min_by("node", F.struct((-F.col("hops")).alias("h"), "node")).alias("target"))
    return graph.shortest_path(t, f.select("book", F.col("focus").alias("source")).join(far, "book"))


@query(f"{_G} SELECT t.book, count(*) AS triples, (SELECT count(DISTINCT node) FROM ends e WHERE e.book = t.book) AS entities, count(DISTINCT relation) AS relations FROM triples t GROUP BY t.book")
def graph_stats(s, d, of=_triples):
    return graph.stats(of(s, d))


@query(f"{_GRAPH}, g AS (SELECT book, source, count(*) AS n FROM triples GROUP BY 1, 2) SELECT book, source, n, round(n / sum(n) OVER (PARTITION BY book), 4) AS share FROM g")
def source_share(s, d, of=_triples):
    return graph.source_share(of(s, d))


@query(f"{_G} SELECT g.book, g.name, CASE WHEN e.type = '地点' THEN 'rect' WHEN e.type IN ('势力', '家族') THEN 'diamond' ELSE 'circle' END AS shape, round(least(14 + sqrt(degree) * 3.2, 40.0), 3) AS size FROM degrees g LEFT JOIN entity e ON e.book = g.book AND e.canon = g.name")
def graph_layout_attrs(s, d, of=_triples):
    return graph.layout(of(s, d), table(s, d, "entity"))


_CATEGORY_SQL = "CASE relation " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in CATEGORY.items()) + " ELSE 'other' END"


@query(f"{_GRAPH} SELECT book, {_CATEGORY_SQL} AS category, count(*) AS n FROM triples GROUP BY 1, 2")
def category_counts(s, d, of=_triples):
    c = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORY.items() for x in kv)), F.col("relation")), F.lit("other"))
    return of(s, d).groupBy("book", c.alias("category")).agg(F.count("*").alias("n"))


# Time, runs, provider -----------------------------------------------------------------------------------------------------------


def _events(s, d):
    return table(s, d, "events")


@query("SELECT count(*) AS calls, round(sum(value), 4) AS amount FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 HOUR")
def usage_last_5h(s, d):
    return usage.last_hours(_events(s, d), 5)


@query("SELECT event_id, event_type AS key, round(sum(value) OVER w, 4) AS spent, round(sum(value) OVER w, 4) > 60 AS over FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 75 SECONDS PRECEDING AND CURRENT ROW)".replace(" AS over ", ' AS "over" '))
def tpm_window(s, d):
    return usage.throttle(_events(s, d), 75, 60.0)


@query("SELECT strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS calls FROM events GROUP BY 1, 2")
def daily_quota(s, d):
    return usage.daily(_events(s, d))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS amount, max(value) AS largest FROM events GROUP BY 1")
def usage_report(s, d):
    return usage.report(_events(s, d))


@query("WITH g AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls FROM events GROUP BY 1, 2) SELECT event_type, day, calls, CAST(sum(calls) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS so_far FROM g")
def usage_running(s, d):
    return usage.running(_events(s, d))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS calls FROM events GROUP BY 1, 2")
def usage_hourly(s, d):
    return usage.tumbling(_events(s, d))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls FROM n GROUP BY user_id, k""")
def usage_sessions(s, d):
    return usage.sessions(_events(s, d))


@query(f"""SELECT book, {q.strip("head")} AS head, {q.strip("relation")} AS relation, {q.strip("tail")} AS tail, count(*) AS mentions, count(DISTINCT {q.squeeze("coalesce(evidence, '')")}) AS votes
FROM relations WHERE head IS NOT NULL AND relation IS NOT NULL AND tail IS NOT NULL GROUP BY 1, 2, 3, 4""")
def incremental_votes(s, d):
    """Exact votes of a stream over several files of assertions, a batch for each file."""
    at = f"{shared_folder(s).rstrip('/')}/loomgraph/incremental-{uuid.uuid4().hex}"
    r = _relations(s, d)
    r.repartition(3).write.parquet(f"{at}/in")
    incremental.append_votes(s, f"{at}/in", r.schema, f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return incremental.read_votes(s, f"{at}/state").select("book", "head", "relation", "tail", "mentions", "votes")


@query("""SELECT book, name, is_primary FROM (SELECT book, name, suffix(name, 'full') AS is_primary, row_number() OVER (PARTITION BY book ORDER BY suffix(name, 'full') DESC, CASE WHEN suffix(name, 'full') THEN name END DESC NULLS LAST, name) AS k
FROM (SELECT DISTINCT book, pack || CASE WHEN round = 2 THEN '_full' ELSE '' END AS name FROM relations WHERE evidence IS NOT NULL) r) x WHERE k = 1""")
def run_catalog(s, d):
    """Runs: each (book, pack) with evidence; those with a second round are the full ones."""
    r = _relations(s, d).where("evidence is not null").select("book", F.concat("pack", F.when(F.col("round") == 2, "_full").otherwise("")).alias("name"), F.lit(True).alias("has_triples")).distinct()
    return files.primary_runs(r)


@query(ORACLE["pack_chapters"].replace("SELECT book, format(", "SELECT book, pack_id AS pack FROM (SELECT book, format(") + ") z WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.book = z.book AND r.pack = z.pack_id AND r.round = 2)")
def resume_pending_packs(s, d):
    """Packs that have had no second round."""
    return files.pending(pack_chapters(s, d).select("book", F.col("pack_id").alias("pack")), _relations(s, d).where("round = 2"))


_KEY_SQL = "sha256('m1' || chr(10) || {})"


@query(f"""WITH calls AS (SELECT DISTINCT {_KEY_SQL.format("evidence")} AS key, round FROM relations WHERE evidence IS NOT NULL), memo AS (SELECT DISTINCT key FROM calls WHERE round = 1)
SELECT CASE WHEN m.key IS NOT NULL THEN 'hit' ELSE 'miss' END AS kind, count(*) AS n FROM (SELECT DISTINCT key FROM calls) c LEFT JOIN memo m USING (key) GROUP BY 1""")
def llm_cache_hit_miss(s, d):
    """Calls: the quotations; the memo has those of the first round."""
    calls = _relations(s, d).where("evidence is not null").select(provider.call_key("m1", F.col("evidence")).alias("key"), F.col("evidence").alias("payload"), "round")
    memo = calls.where("round = 1").select("key", F.lit("{}").alias("answer")).distinct()
    hits, misses = provider.hits_and_misses(calls.select("key", "payload").distinct(), memo)
    n = lambda x, kind: x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(hits, "hit").unionAll(n(misses, "miss")).where("n > 0")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload_explode(s, d):
    return _events(s, d).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, sha256('m1' || chr(10) || props) AS key FROM events")
def payload_hash(s, d):
    return _events(s, d).select("event_id", provider.call_key("m1", F.col("props")).alias("key"))


@query()
def json_salvage(s, d):
    """Answers cut off after a part of their length, and fenced ones, brought back to JSON."""
    cut = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return _events(s, d).select("event_id", provider.salvaged(cut).alias("json"))


# The whole chain ----------------------------------------------------------------------------------------------------------------


def _chain(s, d):
    from loomgraph.plans.pipeline import Pipeline

    p = Pipeline(_relations(s, d), table(s, d, "entity"), table(s, d, "relation_spec"), merge_map=table(s, d, "merge_map"))
    p.proposals = _relations(s, d).select(F.col("assertion_id").alias("id"), "book", "head", strip_all(F.col("relation")).alias("relation"), "tail", F.col("evidence").alias("reason"))
    p.verdicts = _verdicts(p.candidates())
    return p


def replay(s: SparkSession, d: str) -> DataFrame:
    """Validate, aggregate, review, repair, infer and evaluate everything: the chain that the published replay figure is of."""
    return _chain(s, d).metrics(_gold(s, d), _gold_alias(s, d))


QUERIES["replay"] = replay


# The same queries over the finished graph: the reviewed, merged and functionally resolved text layer.  They have no SQL.


def _whole_text(s, d):
    return _chain(s, d).text_layer()


def _whole_triples(s, d):
    return _chain(s, d).triples().select(*aggregate.KEY, "votes", "source", "evidence")


def _whole(names: str, of) -> None:
    for name in names.split():
        QUERIES[f"whole_{name}"] = partial(QUERIES[name], of=of)


_whole("export_triples eval_layers eval_by_relation eval_missed eval_extra audit_wilson degree top_degree high_confidence_edges ego_network relation_lookup entity_detail", _whole_triples)
_whole("bfs_distances shortest_path graph_stats source_share graph_layout_attrs category_counts", _whole_triples)
_whole("additions_filter edges_closure_sym infer_fixpoint human_sample", _whole_text)
_whole("rule_two_hop rule_three_hop rule_dominant rule_sibling rule_grandparent rule_cousin_unless", _whole_text)
_whole("ablation_matrix", _edges)  # which reviews by itself
