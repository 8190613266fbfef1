"""URL filter: rules first, then a tree of path templates per host.

Paths are cut into segments. A segment that looks variable (a number, a hex
string, a date, a file name after one of these, a long slug) becomes a wildcard
at once. Then, level by level from the root:

1. literal segments that hold less than a share of their parent's urls are
   generalised into the wildcard branch;
2. literal branches whose labelled rate does not differ from the rest of their
   parent (two-proportion z test) are merged into the wildcard branch too, if
   both have labels enough to tell.

A url's template is the path of its branches. Its share of bad labels is smoothed
towards the share of the same template under other hosts, that towards the share of
its host, that towards its parent domain's and that towards the overall share, so a
template without labels of its own is judged by what it borrows. A template that
differs between parent domains (z test of each against the others) borrows from its
own domain only. Templates whose smoothed share reaches a bound are rejected.

All statistics are group-bys with partial aggregation over (host, branch), joined
back by key; rows of a hot host are combined before the shuffle and no window or
list gathers the urls of one host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from facetframe.session import checkpointed

#: Levels of the tree; deeper segments share the wildcard tail.
DEPTH = 4
#: Least share of its parent's urls for a literal branch.
LEAST_SHARE = 0.02
#: Labels needed on both sides before two branches of the tree are merged as alike.
LEAST_LABELS = 10
#: z value from which branches differ.
DIFFERENT = 2.58
#: Weight of the prior, in labels.
PRIOR = 8.0
#: Smoothed share of bad labels from which a template is rejected.
REJECT = 0.75

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_VARIABLE = (
    r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|.*[0-9]{3,}.*|[^/]{40,})"
    r"(?:\.[A-Za-z0-9]{1,5})?$"
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    """Whether a rule ``host/path`` covers the host, or a host below it, and starts the path."""
    rule_host, _, rest = rule.partition("/")
    on_host = (host == rule_host) | host.endswith("." + rule_host)
    return on_host & path.startswith("/" + rest)


def ruled(urls: DataFrame, url: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Add host, path, rule and rule_verdict; rules are (verdict, ``host/path``), the longest wins."""
    host, path = F.col("host"), F.col("path")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in reversed(ordered):
        fits = rule_fits(host, path, rule)
        which = F.when(fits, F.lit(rule)).otherwise(which)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return (
        urls.withColumn("host", host_of(F.col(url)))
        .withColumn("path", path_of(F.col(url)))
        .withColumn("rule", which)
        .withColumn("rule_verdict", verdict)
    )


def segments(path: Column, depth: int = DEPTH) -> list[Column]:
    """The first levels of a path: literal, ``*`` if variable, empty past its end; the last level takes all the rest."""
    trimmed = F.regexp_replace(path, "^/+|/+$", "")
    parts = F.split(trimmed, "/+")
    out = []
    for level in range(depth):
        part = F.coalesce(F.get(parts, F.lit(level)), F.lit(""))
        if level == depth - 1:
            part = F.when(F.size(parts) > depth, F.lit("**")).otherwise(part)
        out.append(F.when(part.rlike(_VARIABLE), F.lit("*")).otherwise(part))
    return out


def templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per (host, raw branch) with its template and the template's smoothed rate.

    ``urls`` needs host, path and bad (1, 0 or null for no label).
    """
    names = [f"s{i}" for i in range(depth)]
    shaped = urls.select("host", "bad", *[s.alias(n) for s, n in zip(segments(F.col("path"), depth), names)])
    counted = shaped.groupBy("host", *names).agg(
        F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"), F.count("bad").alias("labels")
    ).withColumn("bad", F.coalesce("bad", F.lit(0)))
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "labels")]
    tree = checkpointed(counted.select("*", *[F.col(n).alias(f"raw{i}") for i, n in enumerate(names)]))
    parent: list[str] = ["host"]
    for name in names:
        children = tree.groupBy(*parent, name).agg(*sums)
        totals = children.groupBy(*parent).agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "labels")])
        rest, rest_bad = F.col("all_labels") - F.col("labels"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide("all_bad", "all_labels")
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("labels")) + F.try_divide(F.lit(1), rest)))
        z = F.try_divide(F.abs(F.try_divide("bad", "labels") - F.try_divide(rest_bad, rest)), spread)
        enough = (F.col("labels") >= LEAST_LABELS) & (rest >= LEAST_LABELS)
        mixed = (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labels"))
        # With labels of one kind only, branches that are labelled enough are alike.
        alike = F.when(enough & mixed, z < DIFFERENT).otherwise(enough)
        rare = F.col("n") < LEAST_SHARE * F.col("all_n")
        literal = ~F.col(name).isin("", "*", "**")
        chosen = children.join(totals, parent).select(
            *parent, name, F.when(literal & (rare | alike), F.lit("*")).otherwise(F.col(name)).alias("branch")
        )
        tree = checkpointed(tree.join(chosen, [*parent, name]).drop(name).withColumnRenamed("branch", name))
        parent = [*parent, name]
    path = F.concat(F.lit("/"), F.array_join(F.array_remove(F.array(*names), ""), "/"))
    tree = tree.withColumn("template", path)
    per_template = checkpointed(tree.groupBy("host", "template").agg(*sums).withColumn("domain", parent_domain(F.col("host"))))
    rated = rates(per_template)
    raw = [f"raw{i}" for i in range(depth)]
    return tree.select("host", *raw, "template").join(rated, ["host", "template"])


def parent_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _smoothed(bad: Column, labels: Column, towards: Column) -> Column:
    return (bad + PRIOR * towards) / (labels + PRIOR)


def rates(per_template: DataFrame) -> DataFrame:
    """(host, template, counts, borrowed_labels, purity) from counts per host, domain and template."""

    def summed(name: str, *by: str) -> DataFrame:
        return per_template.groupBy(*by).agg(F.sum("bad").alias(f"{name}_bad"), F.sum("labels").alias(f"{name}_labels"))

    overall = summed("any").select(F.coalesce(F.try_divide("any_bad", "any_labels"), F.lit(0.0)).alias("base"))
    # The same template in each parent domain, held against all others.
    in_domain = summed("near", "template", "domain")
    anywhere = in_domain.groupBy("template").agg(F.sum("near_bad").alias("same_bad"), F.sum("near_labels").alias("same_labels"))
    rest, rest_bad = F.col("same_labels") - F.col("near_labels"), F.col("same_bad") - F.col("near_bad")
    pooled = F.try_divide("same_bad", "same_labels")
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("near_labels")) + F.try_divide(F.lit(1), rest)))
    z = F.try_divide(F.abs(F.try_divide("near_bad", "near_labels") - F.try_divide(rest_bad, rest)), spread)
    differs = in_domain.join(anywhere, "template").groupBy("template").agg(F.coalesce(F.max(z) >= DIFFERENT, F.lit(False)).alias("differs"))
    joined = (
        per_template.join(summed("host", "host"), "host")
        .join(summed("domain", "domain"), "domain")
        .join(anywhere.join(differs, "template"), "template")
        .join(in_domain, ["template", "domain"])
        # One row with the overall share goes beside every template.
        .join(F.broadcast(overall))
    )
    from_host = _smoothed(F.col("host_bad"), F.col("host_labels"), _smoothed(F.col("domain_bad"), F.col("domain_labels"), F.col("base")))
    lent = lambda c: F.when(F.col("differs"), F.col(f"near_{c}")).otherwise(F.col(f"same_{c}")) - F.col(c)
    purity = _smoothed(F.col("bad"), F.col("labels"), _smoothed(lent("bad"), lent("labels"), from_host))
    return joined.select(
        "host",
        "template",
        F.col("n").alias("template_urls"),
        F.col("labels").alias("template_labels"),
        (lent("labels") + F.col("domain_labels")).alias("borrowed_labels"),
        purity.alias("purity"),
    )


def judged(
    urls: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    carry: Sequence[str] = ("page_id",),
    labels: DataFrame | None = None,
    label_key: str = "page_id",
    depth: int = DEPTH,
) -> DataFrame:
    """One row per url: carried columns, host, path, rule, template, purity, verdict.

    The verdict (allow or block) is the rule's where one fits, else the tree's.
    Labels of urls come from the rules that fit them; ``labels`` (key, bad) may
    add others, a rule's verdict goes before them and several labels of one key
    count as bad if any is. A null url, or one without ``://``, has empty host and
    path, fits no rule, and is allowed unless labels say otherwise. Repeated urls
    count each time; very long paths keep their first levels. A template that neither it,
    the same template elsewhere nor its domain has a label for is allowed; with no labels
    at all everything outside the rules is. A share equal to the bound is rejected.
    Other columns, whatever their names, are dropped unless carried.
    """
    keys = [F.col(c).alias(f"k_{c}") for c in dict.fromkeys([*carry, *([label_key] if labels is not None else [])])]
    rows = ruled(urls.select(*keys, F.col(url).alias("url")), "url", rules)
    bad = F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("int"))
    if labels is not None:
        told = labels.groupBy(F.col(label_key).alias(f"k_{label_key}")).agg(F.max("bad").alias("said"))
        rows = rows.join(told, f"k_{label_key}", "left")
        bad = F.coalesce(bad, F.col("said").cast("int"))
    rows = rows.withColumn("bad", bad)
    known = templates(rows, depth)
    raw = [f"raw{i}" for i in range(depth)]
    shaped = rows.select("*", *[s.alias(n) for s, n in zip(segments(F.col("path"), depth), raw)])
    found = shaped.join(known, ["host", *raw])
    # Without a label anywhere near, there is nothing to judge by.
    reject = (F.col("borrowed_labels") > 0) & (F.col("purity") >= REJECT)
    return found.select(
        *[F.col(f"k_{c}").alias(c) for c in carry],
        "host",
        "path",
        "rule",
        "template",
        "purity",
        F.coalesce("rule_verdict", F.when(reject, "block").otherwise("allow")).alias("verdict"),
    )
