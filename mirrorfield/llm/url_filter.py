r"""URL filters: rules, and a path-template tree for the urls that no rule covers. DataFrame expressions only.

1. A path's segments become template segments: digits N, hexadecimal runs H, words with digits in them V; other
   segments stay as they are if they are common on their host or their blocked share differs significantly from their
   siblings', at their level or below the same parent; else they become the wildcard *. All segments count.
2. Branches are merged: of the segments that stay below a parent, in the order of their blocked shares, neighbours on
   the same side of the purity at which templates are rejected become one branch unless their shares differ
   significantly. It is named ~ and its first segment.
3. Per host the templates' prefixes form a tree; each node counts labelled urls and those of them that are blocked.
   Nodes of the same template on several hosts share one count unless a host's share differs significantly from it.
4. A template is rejected if its purity, the blocked share smoothed towards its parent's, reaches a threshold. The
   deepest node with enough labels speaks.

Labels are the verdicts of the rules on the urls that they cover, or any column that the caller names. Nodes are told
by 64-bit hashes of their paths from the root, so paths of any length have one row a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorfield.llm.common import checkpointed, join_skewed, table

#: (host, path, verdict) of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A literal segment that this many urls have stays if they are this share of its host's urls, or if it differs from its siblings.
LITERAL_SHARE, LITERAL_COUNT = 0.01, 3
#: Pseudo-labels at the parent's share, and the purity at which a template is rejected.
SMOOTHING, PURITY = 4.0, 0.6
#: Labels that a node needs to speak, and the normal deviate at which two shares differ.
SUPPORT, DIFFERS = 3, 2.58


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)).otherwise("")
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (F.instr(rest, "/") > 0), F.substr(rest, F.instr(rest, "/"))).otherwise(""), F.lit(""))


def _after(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (rule, verdict) that fits the host or a parent domain and starts the path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _typed(segment: Column) -> Column:
    bare = F.regexp_replace(segment, r"\.[a-zA-Z]{2,5}$", "")
    return (
        F.when(bare.rlike(r"^[0-9]+$"), "{N}")
        .when(bare.rlike(r"^[0-9a-fA-F-]{8,}$"), "{H}")
        .when(bare.rlike(r"[0-9]"), "{V}")
        .otherwise(segment)
    )


def _apart(labelled: Column, blocked: Column, others: Column, other_blocked: Column) -> Column:
    """Whether two blocked shares differ significantly; not where there are no labels."""
    pooled = (blocked + other_blocked + 0.5) / (labelled + others + 1.0)
    gap = F.abs(F.try_divide(blocked, labelled) - F.try_divide(other_blocked, others))
    noise = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), labelled) + F.try_divide(F.lit(1.0), others)))
    return F.coalesce(gap > DIFFERS * noise, F.lit(False))


def _differs() -> Column:
    """Whether a segment's blocked share differs significantly from its siblings'."""
    others, other_blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    return (F.col("n") >= LITERAL_COUNT) & (F.col("labelled") >= SUPPORT) & _apart(F.col("labelled"), F.col("blocked"), others, other_blocked)


def _chain(parts: Column) -> Column:
    """A number for the root and for each of its descendants down the path: equal paths, equal numbers."""
    return F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda a, s: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), s))))


def merged_branches(siblings: DataFrame) -> DataFrame:
    """(host, level, parent, segment, part) of (host, level, parent, segment, labelled, blocked): part is the segment's own name or that of the
    branch that it is merged into. Segments without labels stay by themselves."""
    below = Window.partitionBy("host", "level", "parent")
    order = below.orderBy("share", "segment")
    shares = siblings.where("labelled > 0").withColumn("share", F.col("blocked") / F.col("labelled"))
    before = [F.lag(c).over(order) for c in ("labelled", "blocked", "share")]
    new = before[0].isNull() | _apart(F.col("labelled"), F.col("blocked"), before[0], before[1]) | ((F.col("share") >= PURITY) != (before[2] >= PURITY))
    runs = shares.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy("host", "level", "parent", "run")
    parts = F.when(F.count("*").over(of_run) > 1, F.concat(F.lit("~"), F.min("segment").over(of_run))).otherwise(F.col("segment"))
    named = runs.withColumn("part", parts).select("host", "level", "parent", "segment", "part")
    return named.unionByName(siblings.where("labelled = 0").select("host", "level", "parent", "segment", F.col("segment").alias("part")))


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, label: str | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of urls (page_id, url).

    label: a column of urls, 1 for blocked and 0 for allowed, null where unknown; else the rules' verdicts are the labels.
    Null urls, and urls without ://, have empty host and path and the root's template. With no labels at all, purity is 0 and
    what no rule covers is allowed. Repeated rows each get the same verdict. Other columns are ignored; no rows give no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = urls.select("page_id", F.col("url").cast("string").alias("url"), *([F.col(label).cast("int").alias("label")] if label else []))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), *(["label"] if label else []))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if not label:
        rows = rows.withColumn("label", F.when(F.col("r.verdict") == "block", 1).when(F.col("r.verdict") == "allow", 0))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumn("segments", F.transform(parts, _typed))
    # one row for each host and typed path, so that a hot host is counted before anything moves
    shapes = checkpointed(rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum(F.coalesce("label", F.lit(0))).alias("blocked")))
    on_host = shapes.groupBy("host").agg(F.sum("n").alias("total"))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    every = [F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")]
    at = ["host", "level", "parent", "segment"]
    parted = shapes.withColumn("chain", _chain(F.col("segments"))).select("*", F.posexplode("segments").alias("level", "segment")).withColumn("parent", F.get("chain", F.col("level"))).drop("chain")
    here = checkpointed(parted.groupBy(*at).agg(*sums))
    below = here.join(here.groupBy("host", "level", "parent").agg(*every), ["host", "level", "parent"]).where(_differs()).select(*at)
    level = here.groupBy("host", "level", "segment").agg(*sums)
    level = level.join(level.groupBy("host", "level").agg(*every), ["host", "level"]).join(on_host, "host")
    common = level.where(((F.col("n") >= LITERAL_COUNT) & (F.col("n") >= LITERAL_SHARE * F.col("total"))) | _differs()).select("host", "level", "segment")
    stay = here.select(*at).join(common, ["host", "level", "segment"], "left_semi").select(*at).union(below).distinct()
    typed = F.substring("segment", 1, 1) == "{"
    stay = checkpointed(merged_branches(here.where(~typed).join(stay, at, "left_semi")))
    named = parted.select("segments", *at).join(stay, at, "left")
    part = F.when(typed, F.col("segment")).otherwise(F.coalesce("part", F.lit("*")))
    listed = named.groupBy("host", "segments").agg(F.sort_array(F.collect_list(F.struct("level", part.alias("part")))).alias("listed"))
    wild = F.coalesce(F.transform("listed", lambda x: x["part"]), F.array().cast("array<string>"))
    kept = shapes.join(listed, ["host", "segments"], "left").select("host", "segments", wild.alias("template"), "n", "labelled", "blocked")
    kept = checkpointed(kept.withColumn("chain", _chain(F.col("template"))))
    nodes = kept.select("host", F.posexplode("chain").alias("level", "prefix"), "labelled", "blocked").groupBy("host", "level", "prefix").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # branches of the same template on other hosts: merged unless the host's share differs significantly
    over = nodes.groupBy("level", "prefix").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    share = (F.col("all_blocked") + 0.5) / (F.col("all_labelled") + 1.0)
    mine = F.col("blocked") / F.col("labelled")
    apart = (F.col("labelled") > 0) & (F.abs(mine - share) > DIFFERS * F.sqrt(share * (1 - share) / F.col("labelled")))
    merged = nodes.join(over, ["level", "prefix"]).withColumn("own", F.coalesce(apart, F.lit(False)))
    rest = merged.where("not own").groupBy("level", "prefix").agg(F.sum("labelled").alias("rest_labelled"), F.sum("blocked").alias("rest_blocked"))
    merged = merged.join(rest, ["level", "prefix"], "left")
    counted = merged.select(
        "host",
        "level",
        "prefix",
        F.when(F.col("own"), F.col("labelled")).otherwise(F.coalesce("rest_labelled", F.lit(0))).alias("labelled"),
        F.when(F.col("own"), F.col("blocked")).otherwise(F.coalesce("rest_blocked", F.lit(0))).alias("blocked"),
    )
    # down the tree: each node's share is smoothed towards the one above it
    up = kept.select("host", "segments", F.posexplode("chain").alias("level", "prefix")).join(counted, ["host", "level", "prefix"])
    line = up.groupBy("host", "segments").agg(F.sort_array(F.collect_list(F.struct("level", "labelled", "blocked"))).alias("line"))
    down = F.aggregate(
        "line",
        F.struct(F.lit(0.0).alias("purity"), F.lit(0).alias("level")),
        lambda a, x: F.when(
            x["labelled"] >= SUPPORT, F.struct(((x["blocked"] + SMOOTHING * a["purity"]) / (x["labelled"] + SMOOTHING)).alias("purity"), x["level"].alias("level"))
        ).otherwise(a),
    )
    verdicts = kept.join(line.select("host", "segments", down.alias("d")), ["host", "segments"])
    speaks = F.concat(F.lit("/"), F.array_join(F.slice("template", F.lit(1), F.col("d.level")), "/")).alias("template")
    judged = join_skewed(rows, verdicts.select("host", "segments", speaks, F.round("d.purity", 9).alias("purity"), "n"), ["host", "segments"], "n")
    method = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "template", "purity")


def op10_url_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
