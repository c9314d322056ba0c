"""Entity registry: building it from reports, its alias index, guards and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_all
from loomgraph.plans.frames import cut, uncut

PERSON = "人物"


def alias_index(entity: DataFrame) -> DataFrame:
    """(book, name, canon, type, entity_id): every name form and its owner."""
    own = entity.select("book", F.col("canon").alias("name"), "canon", "type", "entity_id")
    more = entity.select("book", F.explode("aliases").alias("name"), "canon", "type", "entity_id").select("book", strip_all(F.col("name")).alias("name"), "canon", "type", "entity_id")
    return own.unionAll(more).where("name <> ''").distinct()


def name_forms(alias: DataFrame) -> DataFrame:
    """(book, canon, names)."""
    return alias.groupBy("book", "canon").agg(F.collect_set("name").alias("names"))


def build(reports: DataFrame) -> DataFrame:
    """One entity for each (book, name): number of reports, longest identity (the earliest of equals), first type given, number of packs."""
    blank = lambda c: F.when(strip_all(F.col(c)) != "", F.col(c))
    r = reports.where("book is not null and name is not null").select("book", "name", "entry_id", "pack", blank("identity").alias("identity"), blank("type").alias("type"))
    return r.groupBy("book", "name").agg(
        F.count("*").alias("mentions"),
        F.max_by("identity", F.when(F.col("identity").isNotNull(), F.struct(F.length("identity"), -F.col("entry_id")))).alias("identity"),
        F.min_by("type", F.when(F.col("type").isNotNull(), F.col("entry_id"))).alias("type"),
        F.count_distinct("pack").alias("packs"),
    )


def alias_claims(reports: DataFrame) -> DataFrame:
    """(book, alias, name, entry_id, pos): aliases as reported, blanks and the name itself left out."""
    c = reports.where("book is not null and name is not null").select("book", "name", "entry_id", F.posexplode("aliases").alias("pos", "alias"))
    return c.select("book", strip_all(F.col("alias")).alias("alias"), "name", "entry_id", "pos").where("alias <> '' and alias <> name")


def first_owners(reports: DataFrame) -> DataFrame:
    """(book, alias, owner): a canonical name owns itself; any other belongs to its first claimant."""
    canon = reports.where("book is not null and name is not null").select("book", F.col("name").alias("alias"), "name", F.lit(-1).cast("long").alias("entry_id"), F.lit(0).alias("pos"))
    every = canon.distinct().unionByName(alias_claims(reports))
    return every.groupBy("book", "alias").agg(F.min_by("name", F.struct("entry_id", "pos", "name")).alias("owner"))


def alias_conflicts(reports: DataFrame) -> DataFrame:
    """(book, alias, claimant, owner): claims of names that belong to another."""
    return alias_claims(reports).join(first_owners(reports), ["book", "alias"]).where("name <> owner").select("book", "alias", F.col("name").alias("claimant"), "owner").distinct()


def resolve(df: DataFrame, alias: DataFrame, column: str, out: str) -> DataFrame:
    a = alias.select(F.col("book").alias("_b"), F.col("name").alias("_n"), F.col("canon").alias(out))
    return df.join(a, (df["book"] == F.col("_b")) & (strip_all(df[column]) == F.col("_n")), "left").drop("_b", "_n")


def guard_reason(pairs: DataFrame, generic: list[str]) -> Column:
    """Why an alias is refused: over (canon, alias, type, canon_freq, alias_freq, canon_surname, alias_surname), surnames null where there is none."""
    c, a = F.col("canon"), F.col("alias")
    strong = (F.col("alias_freq") >= 20) & (F.col("alias_freq") >= 0.5 * F.greatest(F.col("canon_freq"), F.lit(1))) & ~F.endswith(c, a)
    person = F.col("type") == PERSON
    return (
        F.when(a.isin(generic) | (a == F.col("alias_surname")), "generic")
        .when(F.length(a) == 1, F.when(F.endswith(c, a) & (F.col("canon_freq") >= 100), F.lit(None)).otherwise("short"))
        .when(person & (F.length(a) == 2) & F.length(c).between(2, 3) & (F.substring(a, 1, 1) == F.substring(c, 1, 1)) & F.col("alias_surname").isNotNull() & (F.substring(a, 2, 9) != F.substring(c, 2, 9)), "same surname")
        .when(person & F.col("canon_surname").isNotNull() & F.col("alias_surname").isNotNull() & (F.col("canon_surname") != F.col("alias_surname")), "other surname")
        .when((~person | F.col("alias_surname").isNotNull()) & strong, "strong")
    )


def surnames(entity: DataFrame) -> DataFrame:
    """(surname): first characters of Han person names; two characters where the name has four or more."""
    han = entity.where((F.col("type") == PERSON) & F.col("canon").rlike("^[一-龥]+$"))
    return han.select(F.when(F.length("canon") >= 4, F.substring("canon", 1, 2)).otherwise(F.substring("canon", 1, 1)).alias("surname")).distinct()


def with_surname(df: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """The two-character surname goes before the one-character one."""
    s = lambda n: names.where(F.length("surname") == n).select(F.col("surname").alias(f"_s{n}"))
    d = df.join(s(2), F.substring(column, 1, 2) == F.col("_s2"), "left").join(s(1), F.substring(column, 1, 1) == F.col("_s1"), "left")
    return d.withColumn(out, F.coalesce("_s2", "_s1")).drop("_s1", "_s2")


def alias_guard(reports: DataFrame, entity: DataFrame, candidate: DataFrame, generic: list[str]) -> DataFrame:
    """(book, canon, alias, reason) of all claimed pairs; a null reason lets the alias pass."""
    freq = candidate.where("freq >= 1").groupBy("book", strip_all(F.col("name")).alias("n")).agg(F.sum("freq").alias("f"))
    f = lambda on, out: freq.select(F.col("book"), F.col("n").alias(on), F.col("f").alias(out))
    pairs = alias_claims(reports).select("book", F.col("name").alias("canon"), "alias").distinct().join(entity.select("book", "canon", "type"), ["book", "canon"])
    pairs = pairs.join(f("canon", "canon_freq"), ["book", "canon"], "left").join(f("alias", "alias_freq"), ["book", "alias"], "left").na.fill(0, ["canon_freq", "alias_freq"])
    names = surnames(entity)
    pairs = with_surname(with_surname(pairs, names, "canon", "canon_surname"), names, "alias", "alias_surname")
    return pairs.select("book", "canon", "alias", guard_reason(pairs, generic).alias("reason"))


def keep_map(merge_map: DataFrame) -> DataFrame:
    """(book, dropped, root): each name goes to the smallest smaller name it is matched with, and on to the root, by pointer jumping."""
    pairs = merge_map.where("book is not null and alias <> '' and canon <> '' and alias <> canon").select("book", F.greatest("alias", "canon").alias("dropped"), F.least("alias", "canon").alias("keep"))
    p = cut(pairs.groupBy("book", "dropped").agg(F.min("keep").alias("keep")))
    while True:
        up = p.select("book", F.col("dropped").alias("keep"), F.col("keep").alias("grand"))
        q = cut(p.join(up, ["book", "keep"], "left").select("book", "dropped", F.coalesce("grand", "keep").alias("keep"), F.col("grand").isNotNull().alias("moved")))
        uncut(p)
        p = q
        if not q.where("moved").limit(1).count():
            return q.select("book", "dropped", F.col("keep").alias("root"))


def render(entity: DataFrame, top: int) -> DataFrame:
    """(book, rank, line) of the most mentioned entities of each book."""
    al = F.array_join(F.array_sort(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))), "｜")
    line = F.concat(
        F.lit("- "), "canon", F.when(al != "", F.concat(F.lit("（"), al, F.lit("）"))).otherwise(""), F.lit("［"), F.coalesce("type", F.lit("")), F.lit("］"),
        F.when(F.col("identity") != "", F.concat(F.lit("："), "identity")).otherwise(""),
    )
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("mentions"), "ord", "canon"))
    return entity.withColumn("rank", rank).where(F.col("rank") <= top).select("book", "rank", line.alias("line"))


def full_names(names: DataFrame, candidate: DataFrame, entity: DataFrame) -> DataFrame:
    """(book, name, full, options): full names (surname and name, registered or counted at least twice) of the two-character names (book, name)."""
    short = names.where(F.col("name").rlike("^[一-龥]{2}$")).select("book", "name").distinct()
    c = candidate.where("book is not null").select("book", strip_all(F.col("name")).alias("name"), "freq").where("name <> ''")
    counted = c.where("freq >= 1").groupBy("book", "name").agg(F.sum("freq").alias("n")).where("n >= 2").select("book", F.col("name").alias("full"))
    known = entity.where(F.col("type") == PERSON).select("book", F.col("canon").alias("full"))
    full = with_surname(known.unionAll(counted).where(F.col("full").rlike("^[一-龥]{3,4}$")).distinct(), surnames(entity), "full", "s").where("s is not null")
    full = full.select("book", "full", F.expr("substring(full, length(s) + 1)").alias("name"))
    j = short.join(full, ["book", "name"])
    return j.withColumn("options", F.count("*").over(Window.partitionBy("book", "name")))


def affix_pairs(names: DataFrame) -> DataFrame:
    """(book, type, short, long): of two names of one type the shorter begins or ends the longer.  Equi-joined on the affixes, not compared pairwise."""
    n = names.select("book", "type", "name").distinct()
    cuts = F.when(F.length("name") > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda k: F.array(F.substring(F.col("name"), F.lit(1), k), F.expr("name").substr(k + 1, F.length("name"))))))
    long = n.select("book", "type", F.col("name").alias("long"), F.explode(F.array_distinct(cuts)).alias("name"))
    return long.join(n, ["book", "type", "name"]).select("book", "type", F.col("name").alias("short"), "long")


def merge_groups(groups: DataFrame, alias: DataFrame) -> DataFrame:
    """(group_id, book, drop, keep): resolved members of a group and its first resolved member, of one type and different."""
    m = groups.select("group_id", "book", F.posexplode("members").alias("pos", "m")).where("m is not null")
    a = alias.select("book", F.col("name").alias("m"), "canon", "type")
    r = m.select("group_id", "book", "pos", strip_all(F.col("m")).alias("m")).join(a, ["book", "m"])
    first = r.groupBy("group_id", "book").agg(F.min_by(F.struct("canon", "type"), "pos").alias("k"))
    return r.join(first, ["group_id", "book"]).where("canon <> k.canon and type = k.type").select("group_id", "book", F.col("canon").alias("drop"), F.col("k.canon").alias("keep")).distinct()


def last_wins(merge_map: DataFrame) -> DataFrame:
    """(book, alias, canon): of several canons of an alias the last reported one."""
    return merge_map.where("alias <> '' and canon <> '' and alias <> canon").groupBy("book", "alias").agg(F.max_by("canon", "map_id").alias("canon"))
