"""Operator 7: URL filter by rules and by a path-template tree per host.  DataFrame functions only.

Every URL is split into host and path.  A fixed rule list decides where a rule fits; those URLs are the labelled
examples.  The others are judged by the template of their path:

1. *Generalise.*  Level by level below each host, as deep as the paths go, a segment becomes a wildcard if it holds a digit, or if
   its node has more than ``fanout`` children and the segment has less than ``rare`` of the node's URLs.  A file ending is kept.
2. *Merge.*  From the last level to the first, branches of a node that differ in one literal only and whose block rates agree
   within ``z`` standard errors of the rate of all labelled siblings become one branch; unlabelled branches stay on their own, so
   they never inherit a verdict from labelled siblings.
3. *Reject.*  A template is blocked if ``(blocked + strength * prior) / (labelled + strength) >= threshold``.

All counting is done on distinct (host, path) rows with counts, so a host with a third of all URLs is combined before the
shuffle.  Branches and purity are worked out per template, few rows, which the paths meet once; URLs come back to their paths by a
join on the whole (host, path), which spreads a hot host's URLs.

Nulls and URLs without ``://`` have an empty host and path and are judged as such; tables may be empty; repeated rows give
repeated results.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import LOWER, UPPER, ascii_lower, fresh_name, stored

#: (verdict, host, path): fixed values of the query's contract.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
MAX_RULES = 500


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules):
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into an expression")
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, fields null where none does."""
    pick = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(_ordered(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        pick = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(pick)
    return pick


def _general(seg: Column) -> Column:
    """A segment as a wildcard that keeps a file ending."""
    return F.concat(F.lit("*"), F.regexp_extract(seg, "(\\.[a-z]{2,5})?$", 0))


def path_templates(urls: DataFrame, fanout: int = 50, rare: float = 0.01) -> DataFrame:
    """(host, path, template) of (host, path, n) rows: the tree is walked level by level, as deep as the paths go.

    Segments with a digit are wildcards.  Of a node's literal segments, those of a share below ``rare`` are, where the node has
    more than ``fanout`` of them.  A node with no more paths than that cannot have so many segments at any level below, so once
    all nodes are that small the rest of every path follows in one step.
    """
    cur = urls.select("host", "path", "n", F.split(F.regexp_replace("path", "^/", ""), "/").alias("seg"), F.lit("").alias("t"))
    level = 0
    while True:
        left = cur.where(F.size("seg") > level)
        most = left.groupBy("host", "t").agg(F.count(F.lit(1)).alias("paths")).agg(F.max("paths")).first()[0]
        if not most or most <= fanout:
            break
        seg = F.get("seg", F.lit(level))
        literal = left.where(~seg.rlike("[0-9]")).groupBy("host", "t", seg.alias("s")).agg(F.sum("n").alias("m"))
        node = literal.groupBy("host", "t").agg(F.count(F.lit(1)).alias("kids"), F.sum("m").alias("whole")).where(F.col("kids") > fanout)
        wild = literal.join(node, ["host", "t"]).where(F.col("m") < F.lit(rare) * F.col("whole")).select("host", "t", "s", F.lit(True).alias("wild"))
        cur = cur.withColumn("s", seg).join(wild, ["host", "t", "s"], "left")
        step = F.when(F.coalesce("wild", F.lit(False)) | seg.rlike("[0-9]"), _general(seg)).otherwise(seg)
        cur = cur.withColumn("t", F.when(seg.isNotNull(), F.concat("t", F.lit("/"), step)).otherwise(F.col("t"))).drop("wild", "s")
        cur = stored(cur, "templates")  # a level needs the one above it: plans stay linear in depth
        level += 1
    rest = F.transform(F.slice("seg", level + 1, F.greatest(F.size("seg"), F.lit(1))), lambda x: F.when(x.rlike("[0-9]"), _general(x)).otherwise(x))
    whole = F.when(F.size("seg") > level, F.concat("t", F.lit("/"), F.array_join(rest, "/"))).otherwise(F.col("t"))
    return cur.select("host", "path", whole.alias("template"))


def merge_branches(templates: DataFrame, z: float = 3.0) -> DataFrame:
    """(host, template, branch) of (host, template, labelled, blocked) rows, one per template.

    From the last level to the first, the branches of a node that lead on alike (they differ in one segment) are pooled; those whose
    share of blocked URLs lies within ``z`` standard errors of the pool's become one branch, with a wildcard in that place.  A
    template without a label is a branch of its own.
    """
    known = templates.where("labelled > 0").select("host", "template", F.col("labelled").alias("l"), F.col("blocked").alias("b"),
                                                   F.split(F.expr("substring(template, 2)"), "/").alias("seg"))
    each = known.select("host", F.size("seg").alias("k"), F.posexplode("seg").alias("i", "s")).groupBy("host", "k", "i").agg(F.min("s").alias("a"), F.max("s").alias("z"))
    for i in sorted((r["i"] for r in each.where("a <> z").select("i").distinct().collect()), reverse=True):
        known = known.withColumn("tail", F.transform("seg", lambda x, j: F.when(j == i, F.lit("*")).otherwise(x)))
        own, pool = W.partitionBy("host", "seg"), W.partitionBy("host", "tail")
        at = F.get("seg", F.lit(i))
        known = known.withColumns({"nl": F.sum("l").over(own), "nb": F.sum("b").over(own)}).withColumns({
            "p": F.sum("b").over(pool) / F.sum("l").over(pool), "many": F.min(at).over(pool) != F.max(at).over(pool)})
        # at least one URL's worth of spread, so that pure pools accept pure branches only
        alike = F.abs(F.col("nb") / F.col("nl") - F.col("p")) <= F.lit(z) * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("nl"))
        known = known.withColumn("seg", F.when((F.size("seg") > i) & F.col("many") & alike, F.col("tail")).otherwise(F.col("seg")))
        known = stored(known.select("host", "template", "l", "b", "seg"), "branches")
    alone = templates.where("labelled = 0").select("host", "template", F.concat(F.lit("unlabelled:"), "template").alias("branch"))
    return known.select("host", "template", F.concat(F.lit("/"), F.array_join("seg", "/")).alias("branch")).union(alone)


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, threshold: float = 0.8, strength: float = 4.0, prior: float = 0.2,
               fanout: int = 50, rare: float = 0.01, z: float = 3.0) -> DataFrame:
    """``pages`` with host, path, rule, template, branch, purity and verdict; columns of these names are replaced."""
    made = ("host", "path", "rule", "template", "branch", "purity", "verdict")
    own = [c for c in pages.columns if c not in made]
    ruled = fresh_name(pages.columns, "_ruled")
    u = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    u = u.withColumn(ruled, match_rule(F.col("host"), F.col("path"), rules))
    u = u.withColumn("rule", F.col(f"{ruled}.rule")).withColumn(ruled, F.col(f"{ruled}.verdict"))
    counted = u.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(ruled).alias("labelled"),
        F.count(F.when(F.col(ruled) == "block", 1)).alias("blocked"),
    )
    counted = stored(counted, "paths")
    paths = path_templates(counted, fanout, rare)
    per = stored(counted.join(paths, ["host", "path"]).groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "per-template")
    # names and purity are worked out per template; the paths meet them once
    named = per.join(merge_branches(per, z), ["host", "template"])
    purity = named.groupBy("host", "branch").agg(
        ((F.sum("blocked") + F.lit(strength * prior)) / (F.sum("labelled") + F.lit(strength))).alias("purity"))
    known = paths.join(named.join(purity, ["host", "branch"]).select("host", "template", "branch", "purity"), ["host", "template"])
    out = u.join(known, ["host", "path"], "left")
    verdict = F.coalesce(ruled, F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).drop(ruled)


def judge_sql(rules=RULES, depth: int = 8, fanout: int = 50, rare: float = 0.01, z: float = 3.0, threshold: float = 0.8,
              strength: float = 4.0, prior: float = 0.2) -> str:
    """DuckDB SQL of the query over ``pages`` for paths of at most ``depth`` levels."""
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then " for _, h, p in _ordered(rules)]
    rule = "case " + " ".join(f + f"'{h + p}'" for f, (_, h, p) in zip(fits, _ordered(rules))) + " end"
    ruled = "case " + " ".join(f + f"'{v}'" for f, (v, _, _) in zip(fits, _ordered(rules))) + " end"
    ctes = [
        "u0 as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), "
        f"'{UPPER}', '{LOWER}'), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages)",
        f"u as (select *, {rule} as rule, {ruled} as ruled from u0)",
        "c as (select host, path, count(*) n, count(ruled) l, count(*) filter (where ruled = 'block') b from u group by all)",
        "t0 as (select *, string_split(regexp_replace(path, '^/', ''), '/') as seg, '' as t from c)",
    ]
    for i in range(depth):
        s = f"seg[{i + 1}]"
        star = f"'*' || regexp_extract({s}, '(\\.[a-z]{{2,5}})?$')"
        ctes += [
            f"k{i} as (select host, t, {s} as s, sum(n) m from t{i} where {s} is not null and not regexp_matches({s}, '[0-9]') group by all)",
            f"w{i} as (select host, t, s, true as wild from k{i} join (select host, t, count(*) kids, sum(m) a from k{i} group by all) "
            f"using (host, t) where kids > {fanout} and m < {rare} * a)",
            f"t{i + 1} as (select g.host, path, n, l, b, seg, case when {s} is null then g.t else g.t || '/' || "
            f"case when coalesce(wild, false) or regexp_matches({s}, '[0-9]') then {star} else {s} end end as t "
            f"from t{i} g left join w{i} w on g.host = w.host and g.t = w.t and {s} = w.s)",
        ]
    ctes += [f"per as (select host, t, sum(l)::double l, sum(b)::double b from t{depth} group by host, t)",
             f"m{depth} as (select host, t, l, b, string_split(substring(t, 2), '/') as seg from per where l > 0)"]
    for i in reversed(range(depth)):
        ctes += [
            f"x{i} as (select *, list_transform(seg, lambda x, j: case when j = {i + 1} then '*' else x end) as tail from m{i + 1})",
            f"y{i} as (select *, sum(l) over (partition by host, seg) nl, sum(b) over (partition by host, seg) nb, sum(b) over w / sum(l) over w as p, "
            f"min(seg[{i + 1}]) over w <> max(seg[{i + 1}]) over w as many from x{i} window w as (partition by host, tail))",
            f"m{i} as (select host, t, l, b, case when len(seg) > {i} and many and abs(nb / nl - p) <= {z} * sqrt(p * (1 - p) / nl) then tail else seg end as seg from y{i})",
        ]
    ctes += [
        "br as (select host, t, '/' || array_to_string(seg, '/') as branch from m0 union all select host, t, 'unlabelled:' || t from per where l = 0)",
        f"pur as (select host, branch, (sum(b) + {strength * prior}) / (sum(l) + {strength}) as purity from per join br using (host, t) group by all)",
        f"known as (select host, path, purity from t{depth} join br using (host, t) join pur using (host, branch))",
    ]
    return (f"with {', '.join(ctes)} select page_id, host, path, rule, coalesce(ruled, case when purity >= {threshold} "
            "then 'block' else 'allow' end) as verdict from u left join known using (host, path)")
