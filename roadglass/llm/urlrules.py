"""Redirect equivalence: block decisions spread over redirect and canonical-link edges, explicit allows first.

Every url has an address: scheme, fragment, tracking parameters and a closing "/" or index page make no
difference to it. `<link rel="canonical">` and `<meta http-equiv="refresh">` in a page join its address to
the target's (its entities decoded); the connected components of these edges are the aliases. A url that a rule fits keeps that
rule's verdict. Any other is blocked if a rule blocks one of its aliases and none allows one, else allowed.

Null urls, and those without "://", have no host, path or address and are allowed. Null html has no links; html of any
length is read whole. An empty table gives no rows. Equal urls are judged
alike; repeated rows stay. Other columns are not looked at. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, written

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UP, _LOW), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address(url: Column) -> Column:
    """What all variants of a url share; null without "://"."""
    kept = F.filter(F.split(F.regexp_extract(url, _PARTS, 3), "&"), lambda x: ~x.rlike(TRACKING) & (x != ""))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    short = F.regexp_replace(path(url), r"(/index\.html?|/)$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), short, query))


def absolute(target: Column, base: Column) -> Column:
    """A link's target as a whole url."""
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("https:"), target))
        .when(target.startswith("/"), F.concat(F.lit("https://"), host(base), target))
        .otherwise(F.concat(F.lit("https://"), host(base), F.regexp_replace(path(base), r"[^/]*$", ""), target))
    )


def rule_of(rules: tuple, host_col: Column, path_col: Column) -> Column:
    """(name, verdict) of the longest rule that fits; of equals, an allow. Null if none fits."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        value = F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def unescaped(c: Column) -> Column:
    """An attribute's value: what stands for its characters in HTML replaced by them, "&" last."""
    for text, character in (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):
        c = F.replace(c, F.lit(text), F.lit(character))
    return c


def judge(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, host, path, rule, verdict of every row.

    Pages are read once: what is needed of them, which is short, is written to the shared folder.
    """
    u, h = F.col(url), F.col(html)
    ruled_by = rule_of(rules, host(u), path(u))
    found = F.concat(F.regexp_extract_all(h, F.lit(CANONICAL), 1), F.regexp_extract_all(h, F.lit(REFRESH), 1))

    def link(t: Column) -> Column:
        whole = absolute(unescaped(t), u)
        return F.struct(address(whole).alias("v"), rule_of(rules, host(whole), path(whole)).alias("r"))

    links = F.when(h.rlike(r"(?i)canonical|http-equiv"), F.transform(found, link))
    base = pages.select(F.col(id_col).alias("id"), host(u).alias("host"), path(u).alias("path"), ruled_by.alias("r"), address(u).alias("address"), links.alias("links"))
    base, _ = written(base.select("id", "host", "path", F.col("r.name").alias("rule"), F.col("r.verdict").alias("verdict"), "address", "links"), "pages")
    links = base.where("links is not null").select(F.col("address").alias("u"), F.inline("links"))
    nodes = components(links)

    # Only addresses that a rule fits can decide for others.
    ruled = base.where("verdict is not null and address is not null").select("address", "verdict")
    ruled = ruled.unionByName(links.where("r is not null and v is not null").select(F.col("v").alias("address"), F.col("r.verdict").alias("verdict")))
    flags = ruled.groupBy("address").agg(F.bool_or(F.col("verdict") == "allow").alias("allow"), F.bool_or(F.col("verdict") == "block").alias("block"))
    flags = flags.join(nodes, flags["address"] == nodes["node"], "left").select(F.coalesce("root", "address").alias("root"), "allow", "block")
    bad = flags.groupBy("root").agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block")).where("block and not allow").select("root")
    bad = nodes.join(bad, "root").select(F.col("node").alias("address")).union(bad.select(F.col("root").alias("address"))).distinct()

    open_ = base.where("verdict is null and address is not null")
    open_ = open_.join(bad.withColumn("bad", F.lit(True)), "address", "left").withColumn("verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    done = base.where("verdict is not null or address is null").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    out = ["id", "host", "path", "rule", "verdict"]
    return done.select(*out).unionByName(open_.select(*out)).withColumnRenamed("id", id_col)
