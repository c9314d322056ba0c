"""Text structuring: numerals, chapters, packs, sentences, halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_all

#: Values of the Chinese digits (fixed values).
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
#: A heading at the start of a line.
HEADING = "(?dm)^(?:第(?:[0-9]+|[零〇一二两三四五六七八九十百千]+)[回章节卷]|Chapter [0-9]+\\.)[^\\n\\r]*"
SENTENCE_END = "[。！？；\n]"


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def numeral(s: Column) -> Column:
    """Value of a Chinese numeral; null where a character is none or nothing is there.  One fold over the characters inside Catalyst."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("num"), F.lit(False).alias("seen"), F.lit(False).alias("bad"))

    def step(acc: Column, c: Column) -> Column:
        digit, unit = _lookup(DIGITS, c), _lookup(UNITS, c)
        num = F.when(digit.isNotNull(), digit).when(unit.isNotNull(), 0).otherwise(acc["num"])
        total = acc["total"] + F.when(unit.isNotNull(), F.when(acc["num"] > 0, acc["num"]).otherwise(1) * unit).otherwise(0)
        known = digit.isNotNull() | unit.isNotNull()
        return F.struct(total.alias("total"), num.alias("num"), (acc["seen"] | known).alias("seen"), (acc["bad"] | ~known).alias("bad"))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, step, lambda a: F.when(a["seen"] & ~a["bad"], a["total"] + a["num"]))


def heading_number(title: Column) -> Column:
    digits = F.regexp_extract(title, "^(?:第|Chapter )([0-9]+)", 1)
    han = F.regexp_extract(title, "^第([零〇一二两三四五六七八九十百千]+)", 1)
    return F.when(digits != "", digits.cast("int")).when(han != "", numeral(han))


def headings(documents: DataFrame) -> DataFrame:
    """(book, ord, title, number) of all lines that look like headings, in order of chapter, document and place."""
    d = documents.where("book is not null and text is not null").select("book", "chapter", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(HEADING), F.lit(0))).alias("pos", "title"))
    return d.select("book", F.struct(F.coalesce("chapter", F.lit(2147483647)).alias("c"), "doc_id", "pos").alias("ord"), strip_all(F.col("title")).alias("title"), heading_number(strip_all(F.col("title"))).alias("number"))


def sequential_chapters(found: DataFrame) -> DataFrame:
    """(book, index, title, number): the headings that continue the count (the first numbered one sets it; those without number stay).

    A heading of a book is a few bytes; their order is folded in one array for each book.
    """
    start = F.struct(F.lit(None).cast("int").alias("next"), F.array().cast("array<struct<title:string,number:int>>").alias("kept"))

    def step(acc: Column, h: Column) -> Column:
        keep = h["number"].isNull() | acc["next"].isNull() | (h["number"] == acc["next"])
        one = F.array(F.struct(h["title"].alias("title"), h["number"].alias("number")))
        return F.struct(F.when(keep & h["number"].isNotNull(), h["number"] + 1).otherwise(acc["next"]).alias("next"), F.when(keep, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"))

    g = found.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "number"))).alias("h"))
    g = g.select("book", F.posexplode(F.aggregate("h", start, step, lambda a: a["kept"])).alias("i", "c"))
    return g.select("book", (F.col("i") + 1).alias("index"), "c.title", "c.number")


def chapters(documents: DataFrame) -> DataFrame:
    """(book, chapter, doc_id, chars): the first document of each chapter."""
    c = documents.where("book is not null and chapter is not null and text is not null")
    return c.groupBy("book", "chapter").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.length("text"), "doc_id").alias("chars"))


def pack_chapters(chapter_sizes: DataFrame, per_call: int, max_chars: int) -> DataFrame:
    """(book, pack_id, chapters, chars, label): consecutive chapters, closed when full; a pack holds at least one chapter."""
    kind = "array<struct<n:int,first:int,last:int,count:int,chars:int,all:string>>"
    start = F.array().cast(kind)

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        new = last.isNull() | (last["count"] >= per_call) | (last["chars"] + c["chars"] > max_chars)
        one = lambda n, first, count, chars, every: F.array(F.struct(n.cast("int").alias("n"), first.alias("first"), c["chapter"].alias("last"), count.cast("int").alias("count"), chars.cast("int").alias("chars"), every.alias("all")))
        text = c["chapter"].cast("string")
        opened = F.concat(acc, one(F.size(acc) + 1, c["chapter"], F.lit(1), c["chars"], text))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), one(last["n"], last["first"], last["count"] + 1, last["chars"] + c["chars"], F.concat(last["all"], F.lit(","), text)))
        return F.when(new, opened).otherwise(grown)

    g = chapter_sizes.groupBy("book").agg(F.array_sort(F.collect_list(F.struct(F.col("chapter").cast("int").alias("chapter"), F.col("chars").cast("int").alias("chars")))).alias("c"))
    p = g.select("book", F.explode(F.aggregate("c", start, step)).alias("p"))
    label = F.when(F.col("p.count") > 1, F.format_string("第%d–%d章", "p.first", "p.last")).otherwise(F.format_string("第%d章", "p.first"))
    return p.select("book", F.format_string("p%03d", "p.n").alias("pack_id"), F.col("p.all").alias("chapters"), "p.chars", label.alias("label"))


def split_text(text: Column) -> Column:
    """Chapters of one text as an array of (title, number, body, start): the headings that continue the count part it, what stands before the first
    is dropped, a text without a heading is one chapter.  Headings that don't continue the count stay in the body."""
    kind = "array<struct<title:string,number:int,body:string,start:int>>"
    acc0 = F.struct(F.lit(None).cast("int").alias("next"), F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    one = lambda title, number, body, start: F.array(F.struct(title.alias("title"), number.cast("int").alias("number"), body.alias("body"), start.cast("int").alias("start")))

    def step(acc: Column, piece: Column) -> Column:
        heading = F.regexp_extract(piece, HEADING, 0)
        title = strip_all(heading)
        number = heading_number(title)
        keep = (heading != "") & (number.isNull() | acc["next"].isNull() | (number == acc["next"]))
        last = F.try_element_at(acc["out"], F.lit(-1))
        grown = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), one(last["title"], last["number"], F.concat(last["body"], piece), last["start"]))
        out = F.when(keep, F.concat(acc["out"], one(title, number, F.substr(piece, F.length(heading) + 1), acc["pos"]))).when(last.isNull(), acc["out"]).otherwise(grown)
        return F.struct(F.when(keep & number.isNotNull(), number + 1).otherwise(acc["next"]).alias("next"), (acc["pos"] + F.length(piece)).alias("pos"), out.alias("out"))

    found = F.aggregate(F.split(text, HEADING.replace("(?dm)", "(?dm)(?=") + ")"), acc0, step, lambda a: a["out"])
    return F.when(F.size(found) > 0, found).otherwise(one(F.lit(""), F.lit(None), text, F.lit(0)))


def chapter_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, index, title, number, start, body) of every text."""
    d = documents.where("text is not null").select("doc_id", F.posexplode(split_text(F.col("text"))).alias("i", "c"))
    return d.select("doc_id", (F.col("i") + 1).alias("index"), "c.title", "c.number", "c.start", strip_all(F.col("c.body")).alias("body"))


def pack_bodies(documents: DataFrame, packs: DataFrame) -> DataFrame:
    """(book, pack_id, label, text): texts of a pack's chapters in order, parted by an empty line; ``packs`` as of :func:`pack_chapters`, which bounds their number."""
    c = documents.where("book is not null and chapter is not null and text is not null").groupBy("book", "chapter").agg(F.min_by("text", "doc_id").alias("text"))
    p = packs.select("book", "pack_id", "label", F.explode(F.transform(F.split("chapters", ","), lambda x: x.cast("int"))).alias("chapter"))
    g = p.join(c, ["book", "chapter"]).groupBy("book", "pack_id", "label").agg(F.array_sort(F.collect_list(F.struct("chapter", "text"))).alias("t"))
    return g.select("book", "pack_id", "label", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence), from 1."""
    s = F.filter(F.transform(F.split("text", SENTENCE_END), strip_all), lambda x: x != "")
    return documents.select("doc_id", F.posexplode(s).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).alias("pos"), "sentence")


def halve(documents: DataFrame, least: int = 1500) -> DataFrame:
    """(doc_id, cut, chars): where a long text is cut, at the first sentence end from its middle on, else in the middle."""
    d = documents.where(F.length("text") >= least).select("doc_id", "text", F.length("text").alias("chars"), F.floor(F.length("text") / 2).cast("int").alias("mid"))
    run = F.length(F.regexp_extract(F.expr("substring(text, mid + 1)"), "^[^。！？]*[。！？]", 0))
    return d.select("doc_id", (F.col("mid") + run).cast("int").alias("cut"), "chars")


def chapter_range(documents: DataFrame, span: str) -> DataFrame:
    """Documents whose chapter lies in a range 'a-b' or is 'a'."""
    lo, _, hi = span.partition("-")
    return documents.where(F.col("chapter").between(int(lo), int(hi or lo)))


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def split_fallback(documents: DataFrame, deepest: int = 2, least: int = 1500, refused=None) -> DataFrame:
    """(doc_id, depth, start, chars, status): pieces a refusing provider is asked for, halved up to ``deepest`` times where long enough.

    ``refused`` is the provider's answer as a boolean column over (text); pieces still refused at the end are skipped and recorded.
    """
    refused = refused if refused is not None else F.lit(False)
    now = documents.where("text is not null").select("doc_id", F.lit(0).alias("depth"), F.lit(0).alias("start"), "text")
    out = None
    for depth in range(deepest + 1):
        now = now.withColumn("no", refused).withColumn("split", F.col("no") & (F.length("text") >= least) & F.lit(depth < deepest))
        done = now.where("not split").select("doc_id", "depth", "start", F.length("text").alias("chars"), F.when(F.col("no"), "skipped").otherwise("accepted").alias("status"))
        out = done if out is None else out.unionAll(done)
        mid = F.floor(F.length("text") / 2).cast("int")
        at = now.where("split").withColumn("cut", mid + F.length(F.regexp_extract(F.col("text").substr(mid + 1, F.length("text")), "^[^。！？]*[。！？]", 0)))
        left = at.select("doc_id", F.lit(depth + 1).alias("depth"), "start", F.expr("substring(text, 1, cut)").alias("text"))
        right = at.select("doc_id", F.lit(depth + 1).alias("depth"), (F.col("start") + F.col("cut")).alias("start"), F.expr("substring(text, cut + 1)").alias("text"))
        now = left.unionAll(right)
    return out
