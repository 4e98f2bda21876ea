"""URL filter by path-template trees (operator 8), DataFrame functions only.

Rules (host, path prefix) decide first, the longest that fits. Other URLs are judged by the
method: each host has a tree of all its path segments. Counts are aggregated per distinct masked
path before anything else. Level by level, a segment becomes a wildcard where it looks like an
identifier, or where its parent has many children for its rows; levels are added while a branch
has enough paths for that. Then, from domains down to templates, labelled branches of one parent
whose bad shares do not differ beyond ``z`` standard errors are pooled, and a pool's share is
smoothed towards what its parent hands down. A branch hands its share down only if its labels span
its children (two of them and a part ``span`` of all; a domain's also the first segments of its
paths); else it hands down what it got. So a rule's single branch says nothing about its siblings.

A template to which its own tree hands nothing starts from what is known of the same template
elsewhere: in hosts of its ending (the last label of the host), which start from all endings, which
start from ``prior``. Rules and sites label many pages alike, so hosts are the units here, and
endings above them, not pages: each weighs less than one, by its labels, and ``units`` units of what
is above are added.
A template is rejected when its smoothed purity of bad labels reaches ``reject_at``.

The start is ``prior``, below ``reject_at``, if rules are the labels, as these are no sample of the
pages; given labels are one and start from their share.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and takes
the estimate of its empty template; hosts without labels take what their parent domain hands down,
else what other hosts say of the template; templates labelled nowhere take ``prior``;
repeated rows count each; an empty table gives an empty result; other columns are ignored.
Segments that all paths below a branch share cost one round, however many; so rounds grow with the branchings one below
another, not with the lengths of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmill.llm._common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tried first: it wraps the others
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def mask(segment: Column) -> Column:
    """Identifiers become wildcards that keep their kind and extension."""
    tail = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = F.when(stem.rlike(r"^[0-9]+$"), "{n}").when(stem.rlike(r"^[0-9a-fA-F-]{16,}$"), "{x}").when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{d}")
    return F.when(kind.isNotNull(), F.concat(kind, tail)).otherwise(segment)


def segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), mask)


def domain_of(host: Column) -> Column:
    return F.when(host.rlike(r"\..*\."), F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)


def smoothed(bad: Column, n: Column, parent: Column, strength: float, z: float) -> Column:
    """Shrunk share of bad labels; the parent's own where the branch does not differ from it significantly."""
    raw = (bad + strength * parent) / (n + strength)
    error = F.sqrt(F.greatest(parent * (1 - parent), F.lit(0.05)) / F.greatest(n, F.lit(1.0)))
    differs = (n > 0) & (F.abs(F.try_divide(bad, n) - parent) > z * error)
    return F.when(differs, raw).otherwise(parent)


def joined(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def shared(low: Column, high: Column) -> Column:
    """Length of the prefix that the smallest and the largest array, and so all between them, have in common."""
    return F.coalesce(F.nullif(F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False), F.lit(0)) - 1, F.size(low)).cast("int")


def templates(paths: DataFrame, least_children: int, variety: float) -> DataFrame:
    """``paths`` (host, s, n, ...) with the array t, in which variable segments of s are wildcards.

    Input rows are distinct masked paths with counts, not pages, so that hot hosts stay small."""
    out = materialise(paths.withColumn("t", F.array().cast("array<string>")))
    level = F.size("t")
    longer, segment, rest = F.size("s") > level, F.get("s", level), F.slice("s", level + 1, F.lit(1 << 30))
    while True:
        if out.where(longer).groupBy("host", "t").count().where(F.col("count") >= least_children).isEmpty():  # too few paths for a wildcard
            return out.withColumn("t", F.when(longer, F.concat("t", rest)).otherwise(F.col("t")))
        branch = out.where(longer).groupBy("host", "t", segment.alias("segment")).agg(F.sum("n").alias("n"), F.min(rest).alias("low"), F.max(rest).alias("high"))
        tree = branch.groupBy("host", "t").agg(F.count("*").alias("children"), F.sum("n").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
        wide = (F.col("children") >= least_children) & (F.col("children") >= variety * F.col("rows"))
        tree = tree.select("host", "t", wide.alias("wide"), F.greatest(F.lit(1), shared(F.col("low"), F.col("high"))).alias("step"))
        grown = F.concat("t", F.when(F.col("wide"), F.array(F.lit("*"))).otherwise(F.slice("s", level + 1, F.col("step"))))
        out = materialise(out.join(tree, ["host", "t"], "left").withColumn("t", F.when(longer, grown).otherwise(F.col("t"))).drop("wide", "step"))


def pooled(nodes: DataFrame, z: float, bins: int = 16) -> DataFrame:
    """``nodes`` (up, b, k, ...) with the labels ``pb`` of ``pk`` of their pool: siblings of like share, then neighbouring
    shares that do not differ. A parent's shares are at most ``bins`` + 1 rows, however many its children."""
    nodes = nodes.withColumn("bin", F.floor(bins * F.try_divide("b", "k")))
    by_share = nodes.where("k > 0").groupBy("up", "bin").agg(F.sum("b").alias("b"), F.sum("k").alias("k"))
    order = Window.partitionBy("up").orderBy("bin")
    b, k = F.lag("b").over(order), F.lag("k").over(order)
    both = (b + F.col("b")) / (k + F.col("k"))
    error = F.sqrt(F.greatest(both * (1 - both), F.lit(0.05)) * (1 / k + 1 / F.col("k")))
    apart = F.coalesce((F.abs(F.col("b") / F.col("k") - b / k) > z * error).cast("int"), F.lit(0))
    pools = by_share.withColumn("apart", apart).withColumn("pool", F.sum("apart").over(order))
    whole = Window.partitionBy("up", "pool")
    return nodes.join(pools.select("up", "bin", F.sum("b").over(whole).alias("pb"), F.sum("k").over(whole).alias("pk")), ["up", "bin"], "left").drop("bin")


def elsewhere(leaves: DataFrame, strength: float, prior: float, units: float) -> DataFrame:
    """(ending, t, elsewhere) of labelled templates: their share in the hosts of an ending, from that over all endings, from ``prior``.

    Sums of whole thousandths do not depend on the order of rows."""

    def above(share: Column, weight: Column, start: Column) -> Column:
        return (share + units * start) / (weight + units)

    thousandths = lambda x: F.round(1000 * x).cast("long")
    weight = F.col("labelled") / (F.col("labelled") + strength)
    hosts = leaves.where("labelled > 0").select("ending", "t", thousandths(weight).alias("w"), thousandths(weight * F.col("bad") / F.col("labelled")).alias("wb"))
    endings = hosts.groupBy("ending", "t").agg((F.sum("w") / 1000).alias("w"), (F.sum("wb") / 1000).alias("wb")).where("w > 0")
    whole = endings.select("t", thousandths(F.col("w") / (F.col("w") + units)).alias("e"), thousandths(F.col("wb") / (F.col("w") + units)).alias("eb"))
    everywhere = whole.groupBy("t").agg((F.sum("e") / 1000).alias("e"), (F.sum("eb") / 1000).alias("eb")).select("t", above(F.col("eb"), F.col("e"), F.lit(float(prior))).alias("everywhere"))
    own = endings.join(everywhere, "t").select("ending", "t", above(F.col("wb"), F.col("w"), F.col("everywhere")).alias("elsewhere"))
    return own.unionByName(everywhere.select(F.lit(None).cast("string").alias("ending"), "t", F.col("everywhere").alias("elsewhere")))


def purity(found: DataFrame, strength: float, z: float, prior: float, span: float, units: float) -> DataFrame:
    """(host, t, purity) of every template, from domains down until each branch is one template."""
    leaves = found.groupBy("domain", "host", "t").agg(F.sum("bad").cast("double").alias("bad"), F.sum("labelled").cast("double").alias("labelled"))
    leaves = materialise(leaves.withColumn("ending", F.regexp_extract("host", r"[^.]*$", 0)))
    known = materialise(elsewhere(leaves, strength, prior, units))
    near, far = known.where("ending is not null"), known.where("ending is null").select("t", F.col("elsewhere").alias("far"))
    start = F.coalesce("elsewhere", "far", F.lit(float(prior)))
    leaves = leaves.join(near, ["ending", "t"], "left").join(far, "t", "left").withColumn("start", start).drop("ending", "elsewhere", "far")
    state = materialise(leaves.select("*", F.lit(None).cast("double").alias("given"), F.lit(None).cast("double").alias("purity"), F.lit(0).alias("level")))

    def spans(child: Column) -> Column:
        known = F.count_distinct(F.when(F.col("labelled") > 0, child))
        return (known >= 2) & (known >= span * F.count_distinct(child))

    depth, first, level = 0, F.coalesce(F.get("t", F.lit(0)), F.lit("")), F.col("level")
    while True:
        if depth == 0:
            node, up, reaches = F.col("domain"), F.lit(""), spans(F.col("host")) & spans(first)
        elif depth == 1:
            node, up, reaches = F.col("host"), F.col("domain"), spans(first)
        else:
            node, up = (F.concat("host", joined(F.slice("t", F.lit(1), i))) for i in (level - 1, level - 2))
            up, reaches = F.when(level == 2, F.col("host")).otherwise(up), spans(F.coalesce(F.get("t", level - 1), F.lit("")))
        named = state.where("purity is null").withColumn("node", node).withColumn("up", up)
        below = F.greatest(F.first("level"), shared(F.min("t"), F.max("t"))) + 1 if depth else F.lit(1)  # past segments that all of a node's paths share
        nodes = named.groupBy("up", "node").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("k"), F.first("given").alias("g"), F.count("*").alias("leaves"), F.min("start").alias("start"), reaches.alias("reaches"), below.cast("int").alias("below"))
        base = F.coalesce("g", F.when(F.col("leaves") == 1, F.col("start")), F.lit(float(prior)))
        nodes = pooled(nodes, z).withColumn("p", F.when(F.col("k") > 0, smoothed(F.col("pb"), F.col("pk"), base, strength, z)).otherwise(base))
        handed = nodes.select("up", "node", "below", F.when(F.col("reaches"), F.col("p")).otherwise(F.col("g")).alias("handed"), F.when(F.col("leaves") == 1, F.col("p")).alias("own"))
        moved = named.join(handed, ["up", "node"]).select("domain", "host", "t", "bad", "labelled", "start", F.col("handed").alias("given"), F.col("own").alias("purity"), F.col("below").alias("level"))
        state = materialise(state.where("purity is not null").unionByName(moved))
        depth += 1
        if state.where("purity is null").isEmpty():
            return state.select("host", "t", "purity")


def judge(pages: DataFrame, rules=RULES, least_children: int = 8, variety: float = 0.5, strength: float = 4.0, z: float = 2.0, reject_at: float = 0.5, prior: float = 0.25, span: float = 0.5, units: float = 1.0, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every page.

    Labels of the tree are the pages that rules decide, or ``labelled`` (url, bad 0/1)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), joined(segments(F.col("path"))).alias("masked"))
    zero = F.lit(0).cast("long")
    if labelled is None:
        votes = rows.select("host", "masked", F.col("ruled").isNotNull().cast("long").alias("labelled"), (F.coalesce("ruled", F.lit("")) == "block").cast("long").alias("bad"), F.lit(1).alias("n"))
    else:
        known = labelled.select(host_of(F.col("url")).alias("host"), joined(segments(path_of(F.col("url")))).alias("masked"), F.lit(1).cast("long").alias("labelled"), F.col("bad").cast("long").alias("bad"), F.lit(0).alias("n"))
        votes = rows.select("host", "masked", zero.alias("labelled"), zero.alias("bad"), F.lit(1).alias("n")).unionByName(known)
        base = labelled.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
        prior = (base.bad + 0.5) / (base.n + 1.0)
    counted = votes.groupBy("host", "masked").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    counted = counted.withColumn("domain", domain_of(F.col("host"))).withColumn("s", F.filter(F.split("masked", "/", -1), lambda x: x != ""))
    found = templates(counted, least_children, variety)
    table = found.join(purity(found, strength, z, prior, span, units), ["host", "t"])
    by_tree = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    table = table.select("host", "masked", joined(F.col("t")).alias("template"), "purity")
    return rows.join(table, ["host", "masked"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_tree).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
