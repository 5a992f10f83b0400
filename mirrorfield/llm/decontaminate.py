r"""Benchmark decontamination by template canonicalisation. DataFrame expressions only.

1. Numbers, units that follow them and names become typed placeholders; what else is a letter run is lower-cased.
   Placeholder terms keep what they stand for. A name is a capitalised word within a sentence; one that opens a text,
   a sentence or a quotation (an opener) may be a name or a word.
2. Of each item its rarest words are chosen, by a sample of the documents, so that without any of them too few of its
   windows are left; texts without any such word hold no item and are not looked at further.
3. Windows of WIDTH terms are hashed by template: a placeholder counts by its type, and an opener both ways, so that a
   window with k openers has 2 ** k hashes. The benchmark's windows are joined with the documents' on the hash.
4. Each copy of an item in a text is judged by itself. Common windows lie on diagonals (place in the text less place in
   the item); a copy is one diagonal, or a run of diagonals at most SHIFT apart, as names of several words make.
5. A text holds an item if one of its copies has a share of at least COVER of the item's distinct windows and consistent
   slots: an item's slot value stands for one and the same value, and a name of the text for one and the same name, at
   least a share CONSISTENT of the time. So a question with other numbers or names is found, and a chance likeness of
   templates is not. (Two numbers may become the same one, two persons not.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorfield.llm.common import KEY, checkpointed, keyed, table

WIDTH = 5
COVER, CONSISTENT, SHIFT = 0.8, 0.8, 3
#: Up to so many benchmark windows (of a few dozen bytes) are broadcast; more are joined by shuffling, with AQE splitting hot ones.
BROADCAST_WINDOWS = 200_000
#: One document in SAMPLE tells how rare a word is; that sets the cost, never the result. More words than TELLING are not looked for: then all texts are read.
SAMPLE, TELLING = 16, 10_000
UNITS = ("km", "cm", "mm", "m", "kg", "g", "mg", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "percent")
#: Opens a placeholder; the letter after it is the type, the rest is the value.
MARK = "\u0001"
OPENER = MARK + "o"
#: Stands for a dot or comma within a number.
POINT = "\u0002"


def _terms(docs: DataFrame, *key: str) -> DataFrame:
    """(key, w, marked): canonical terms, lower-cased words and placeholders MARK + type + value; whether there are placeholders.

    The first and the last term may be empty. Each step has a projection of its own, so that none is computed twice.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(POINT))
    plain = docs.select(*key, F.when(odd, F.translate(text, MARK + POINT, "  ")).otherwise(text).alias("x"))
    named = plain.select(*key, F.regexp_replace("x", r"\p{Lu}(?<=[\p{Ll}\d,;:] \p{Lu})\p{L}*", MARK + "n$0").alias("x"))
    # what is left opens something, but for the later words of a run of capitals
    named = named.select(*key, F.regexp_replace("x", r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})(?:(?<!\p{Lu} \p{Lu})|(?=\p{Ll}))\p{L}*", MARK + "o$0").alias("x"))
    counted = F.regexp_replace("x", r"(?<=\d)[.,](?=\d)", POINT)
    counted = F.regexp_replace(counted, rf"\d(?<![\p{{L}}\p{{N}}{POINT}]\d)[\d{POINT}]*", MARK + "d$0")
    counted = F.regexp_replace(counted, rf"({MARK}d[\d{POINT}]+) ?({'|'.join(sorted(UNITS, key=len, reverse=True))})\b", f"$1 {MARK}u$2")
    typed = named.select(*key, F.when(F.col("x").rlike(r"\d"), counted).otherwise(F.col("x")).alias("x"))
    return typed.select(*key, F.split(F.lower("x"), rf"[^\p{{L}}\p{{N}}{MARK}{POINT}]+").alias("w"), F.contains("x", F.lit(MARK)).alias("marked"))


def _filled(words: DataFrame) -> DataFrame:
    return words.withColumn("w", F.filter("w", lambda t: t != ""))


def _marked(term: Column) -> Column:
    return F.substring(term, 1, 1) == MARK


def _hashed(words: DataFrame, *key: str) -> DataFrame:
    """(key, t, o): the terms' hashes, of a placeholder by its type and of an opener by its word; 1 for openers, else 0."""
    kind = lambda t: F.substring(t, 1, 2)
    by_type = F.transform("w", lambda t: F.xxhash64(F.when(kind(t) == OPENER, F.substring(t, 3, 1 << 30)).when(_marked(t), kind(t)).otherwise(t)))
    opens = F.transform("w", lambda t: (kind(t) == OPENER).cast("int"))
    return words.select(*key, F.when(F.col("marked"), by_type).otherwise(F.transform("w", lambda t: F.xxhash64(t))).alias("t"), F.when(F.col("marked"), opens).otherwise(F.transform("w", lambda t: F.lit(0))).alias("o"))


def _of_size(size: int, base: bool) -> Column:
    """Structs of the windows of a row: at, h, and with base the hash with all openers as words."""
    starts = F.when(F.size("t") >= size, F.sequence(F.lit(0), F.size("t") - size))
    name = F.xxhash64(F.lit(MARK + "n"))

    def plain(i: Column) -> Column:
        return F.xxhash64(*[F.get("t", i + j) for j in range(size)])

    def chosen(i: Column, mask: Column) -> Column:
        return F.xxhash64(*[F.when(mask.bitwiseAND(1 << j) == 0, F.get("t", i + j)).otherwise(name) for j in range(size)])

    def row(i: Column, h: Column) -> Column:
        return F.struct(i.alias("at"), h.alias("h"), *([plain(i).alias("base")] if base else []))

    def choices(bits: Column) -> Column:
        several = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit((1 << size) - 1)), lambda m: m.bitwiseAND(bits)))
        return F.when(bits.bitwiseAND(bits - 1) == 0, F.array(bits)).otherwise(F.filter(several, lambda m: m > 0))

    # start and bits of the openers of each window that has some; each non-empty choice of them stands for names
    opened = F.transform(starts, lambda i: F.struct(i.alias("i"), reduce(lambda a, b: a + b, [F.get("o", i + j) * F.lit(1 << j) for j in range(size)]).alias("bits")))
    named = F.transform(F.filter(opened, lambda s: s["bits"] > 0), lambda s: F.transform(choices(s["bits"]), lambda m: row(s["i"], chosen(s["i"], m))))
    return F.concat(F.transform(starts, lambda i: row(i, plain(i))), F.flatten(named))


def _windows(words: DataFrame, sizes: list[int], *key: str, base: bool = False) -> DataFrame:
    """(key, size, at, h): hashes of each template window, from its terms' hashes, with openers as words and as names; base: also the one with all as words."""
    out = None
    for size in sizes:
        # outer, as else the optimizer computes the windows twice, to see first that there are some
        part = _hashed(words, *key).select(*key, F.explode_outer(_of_size(size, base)).alias("x")).select(*key, F.lit(size).alias("size"), "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def _slots(words: DataFrame, *key: str) -> DataFrame:
    """(key, at, type, value, opens) of each placeholder; an opener is of the names' type."""
    numbered = F.transform("w", lambda t, i: F.struct(i.alias("at"), F.when(_marked(t), t).alias("t")))
    listed = words.where("marked").select(*key, F.explode_outer(F.filter(numbered, lambda x: x["t"].isNotNull())).alias("s")).where("s is not null")
    return listed.select(*key, F.col("s.at").alias("at"), F.translate(F.substring("s.t", 2, 1), "o", "n").alias("type"), F.substring("s.t", 3, 1 << 30).alias("value"), (F.substring("s.t", 1, 2) == OPENER).alias("opens"))


def _spoken(text: Column) -> Column:
    """All words of a text, lower-cased, whatever their type."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def _telling(docs: DataFrame, words: DataFrame, asked: DataFrame, cover: float) -> list[str] | None:
    """Words of which a text that holds an item has one; None if there are too many, or an item has none.

    An item's plain words are ranked from the rarest on; a window is lost with the first of its words that is missing. So with the
    words up to rank k missing, the windows of rank k or less are lost: k is the least rank at which too many are.
    """
    plain = words.select("item_id", F.posexplode("w").alias("p", "t")).where(~_marked(F.col("t")))
    every = plain.select("t").distinct()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.explode(F.array_distinct(_spoken(F.col("text")))).alias("t"))
    rare = every.join(some.join(every, "t", "left_semi").groupBy("t").count(), "t", "left").select("t", F.coalesce("count", F.lit(0)).alias("n"))
    order = Window.partitionBy("item_id").orderBy("n", "t")
    ranked = checkpointed(plain.select("item_id", "t").distinct().join(rare, "t").withColumn("rank", F.row_number().over(order)).select("item_id", "t", "rank"))
    windows = asked.select("item_id", "size", "base", "item_at").distinct()
    inside = (F.col("p") >= F.col("item_at")) & (F.col("p") < F.col("item_at") + F.col("size"))
    placed = windows.join(plain.join(ranked, ["item_id", "t"]), "item_id").where(inside).groupBy("item_id", "size", "base").agg(F.min("rank").alias("rank"))
    lost = windows.select("item_id", "size", "base").distinct().join(placed, ["item_id", "size", "base"], "left")
    lost = lost.groupBy("item_id").agg(F.sort_array(F.collect_list(F.coalesce("rank", F.lit(1 << 30)))).alias("r"))
    # lost windows that leave less than a share cover
    least = lost.select("item_id", F.get("r", F.greatest(F.size("r") - F.ceil(F.size("r") * cover - 1e-9), F.lit(0)).cast("int")).alias("k"))
    least = checkpointed(least)
    if least.where(F.col("k") == 1 << 30).take(1):
        return None
    found = ranked.join(least, "item_id").where(F.col("rank") <= F.col("k")).select("t").distinct().limit(TELLING + 1).collect()
    return sorted(r["t"] for r in found) if len(found) <= TELLING else None


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: float = COVER, consistent: float = CONSISTENT) -> DataFrame:
    """(_id, _text, item_id, coverage, consistency) for each text that holds an item: those of its best copy, the most consistent one, then the one that covers most.

    Items shorter than width terms are matched whole, by windows of their own length; items without terms, null texts and null ids of items
    match nothing. Texts are told by id and hash (keyed); equal rows count as one text, repeated rows of an item_id as one item with all
    their windows. Other columns are ignored.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    words = _filled(_terms(items, "item_id"))
    sized = words.select("item_id", F.least(F.lit(width), F.size("w")).alias("size")).where("size > 0")
    sizes = sorted(r["size"] for r in sized.select("size").distinct().collect()) or [width]
    asked = _windows(words, sizes, "item_id", base=True).where("h is not null").join(sized, ["item_id", "size"], "left_semi")
    asked = checkpointed(asked.select("item_id", "size", F.col("at").alias("item_at"), "h", "base"))
    totals = asked.groupBy("item_id").agg(F.countDistinct("base", "size").alias("total"))
    small = asked.count() <= BROADCAST_WINDOWS
    there = [*KEY, "item_id"]
    telling = _telling(docs, words, asked, cover)
    if telling is not None:
        docs = docs.where(F.arrays_overlap(_spoken(F.col("text")), F.array(*map(F.lit, telling)))) if telling else docs.where("false")
    hits = _windows(_terms(keyed(docs), *KEY), sizes, *KEY).join(F.broadcast(asked) if small else asked, ["size", "h"])
    hits = checkpointed(hits.select(*there, "size", "base", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())
    # without this no copy can reach the share that it needs
    enough = hits.groupBy(*there).agg(F.countDistinct("base", "size").alias("n")).join(F.broadcast(totals) if small else totals, "item_id").where(F.col("n") >= cover * F.col("total")).select(*there, "total")
    hits = checkpointed(hits.join(enough, there))
    beside = Window.partitionBy(*there).orderBy("diagonal")
    apart = hits.select(*there, "diagonal").distinct().withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(beside) > SHIFT).cast("int"))
    runs = apart.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(beside)).drop("new")
    of_run = F.array(F.struct(F.lit(0).alias("kind"), F.col("diagonal").cast("long").alias("copy")), F.struct(F.lit(1).alias("kind"), F.col("run").alias("copy")))
    copy = [*there, "kind", "copy"]
    placed = hits.join(runs, [*there, "diagonal"]).withColumn("c", F.explode(of_run)).select(*there, "c.kind", "c.copy", "size", "base", "item_at", "diagonal", "total")
    covered = placed.groupBy(*copy).agg((F.countDistinct("base", "size") / F.first("total")).alias("coverage"))
    covered = checkpointed(covered.where(F.col("coverage") >= cover))
    # an opener that is nowhere else a name is a slot only where it is changed
    unnamed = F.min("opens").over(Window.partitionBy("item_id", "value"))
    item_slots = checkpointed(_slots(words, "item_id").withColumn("opens", unnamed))
    # a placeholder of the item and the one of the same type at the same place of the copy, within a common window
    inside = (F.col("at") >= F.col("item_at")) & (F.col("at") < F.col("item_at") + F.col("size"))
    slots = placed.join(covered, copy, "left_semi").join(item_slots, "item_id").where(inside).select(*copy, "type", "value", "opens", (F.col("at") + F.col("diagonal")).alias("at")).distinct()
    texts = keyed(docs).select(*KEY, "text").join(covered.select(*KEY).distinct(), [*KEY])
    others = _slots(_terms(texts, *KEY), *KEY).drop("opens").withColumnRenamed("value", "other").distinct()
    pairs = slots.join(others, [*KEY, "at", "type"]).where(~F.col("opens") | (F.col("value") != F.col("other")))
    pairs = checkpointed(pairs.groupBy(*copy, "type", "value", "other").count())

    def share(rows: DataFrame, by: str, name: str) -> DataFrame:
        """Of what stands more than once, the share that stands for the most frequent; a value that stands once is consistent with anything."""
        each = rows.groupBy(*copy, "type", by).agg(F.max("count").alias("top"), F.sum("count").alias("all")).where(F.col("all") > 1)
        return each.groupBy(*copy).agg((F.sum("top") / F.sum("all")).alias(name))

    forward, back = share(pairs, "value", "forward"), share(pairs.where("type = 'n'"), "other", "back")
    judged = covered.join(forward, copy, "left").join(back, copy, "left")
    judged = judged.withColumn("consistency", F.least(F.coalesce("forward", F.lit(1.0)), F.coalesce("back", F.lit(1.0)))).where(F.col("consistency") >= consistent)
    best = judged.groupBy(*there).agg(F.max(F.struct("consistency", "coverage")).alias("best"))
    return best.select(*there, "best.coverage", "best.consistency")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, items, coverage) for each row; items lists the items held, ascending, coverage is the best."""
    found = matches(docs, benchmark, **options).groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.round(F.max("coverage"), 6).alias("coverage"))
    rows = keyed(docs).select("doc_id", *KEY).join(found, [*KEY], "left")
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    found = checkpointed(matches(docs, benchmark, **options).select(*KEY).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"doc_id": F.col("row.doc_id"), "text": F.col("row.text")})
    return keyed(rows, "row").join(found, [*KEY], "left_anti").select("row.*")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
