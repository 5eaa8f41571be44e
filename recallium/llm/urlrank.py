"""Operator 8: URL filters by rules and propagation over the link graph of hosts.

A url is judged by the longest rule (host, path) that fits it. Where none fits, its host decides:
personalised PageRank carries trust from hosts with allowed pages along links, and distrust from
hosts with blocked pages against them (who links to blocked hosts is distrusted). A host whose
distrust exceeds ``threshold`` times its trust is blocked.

A page links to the host of every url in it (by the same rule as for pages' own urls; in text a
host also ends at white space, quotes and angle brackets) and to the dotted host names that it
mentions. Hosts in the graph are those with pages and linked ones that a rule fits: a linked host
without pages is judged as its home page ``/`` would be, so that who links to blocked hosts is
distrusted though these were never fetched. Links to other hosts take their share of what a page hands on
out of the graph; names without ``://`` before them count only if they are hosts of the graph, as version
numbers and names of files look alike. Edges are counted by pair of hosts before anything else,
so a host that holds a third of all pages is aggregated in each task first. Both ranks are carried
along in one join a round; after ``ROUNDS`` rounds at most ``DAMPING ** ROUNDS`` = 2 % of a rank is
still on its way. Ranks are scaled to 1 a host on average and rounded there, whatever the number of
hosts, so that sums don't depend on their order. Every ``ROUNDS_A_TABLE`` rounds a table is written.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is
allowed; null html has no links; rows that repeat a page id are judged one by one; rules that
are equally long in characters can't both fit unless equal; an empty table gives an empty result;
extra columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path) in the order in which they are stated.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ROUNDS, ROUNDS_A_TABLE = 24, 8
DAMPING = 0.85
THRESHOLD = 1.0
DIGITS = 12
#: Hosts in a page, after A-Z are lower-cased: names of letters, digits and hyphens joined by dots, and what stands after ``://``.
MENTION = r"[a-z0-9-]+(?:[.][a-z0-9-]+)+"
TARGET = r"""://([^/?#\s"'<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, lower-cased, and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(of_path))
        rule, verdict = F.when(fits, of_host + of_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def ranks(edges: DataFrame, hosts: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds hosts(host, good, bad).

    Edges to hosts that aren't among ``hosts`` take their share of what their source hands on, and it is lost."""
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    known = edges.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
    into = known.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = materialize(known.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("into")).alias("back")), "edges")
    # What flows along an edge goes to its end as trust and to its beginning as distrust.
    none = F.lit(0.0)
    ways = shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("forth").alias("t"), none.alias("d")).unionByName(shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), none.alias("t"), F.col("back").alias("d")))
    total = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count("*").alias("n")).first()
    seeds = hosts.select("host", *(F.when(F.lit(bool(t)), F.round(F.col(c) * total["n"] / (t or 1.0), DIGITS)).otherwise(none).alias(c) for c, t in (("good", total["g"]), ("bad", total["b"]))))
    now = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for k in range(rounds):
        moved = ways.join(now, "host").select(F.col("to").alias("host"), (F.col("trust") * F.col("t")).alias("t"), (F.col("distrust") * F.col("d")).alias("d"))
        flow = moved.groupBy("host").agg(*(F.sum(F.round(c, 15).cast("decimal(35,15)")).cast("double").alias(c) for c in ("t", "d")))
        now = seeds.join(flow, "host", "left").select("host", *(F.round((1 - damping) * F.col(s) + damping * F.coalesce(F.col(f), none), DIGITS).alias(c) for s, f, c in (("good", "t", "trust"), ("bad", "d", "distrust"))))
        if k % ROUNDS_A_TABLE == ROUNDS_A_TABLE - 1 or k == rounds - 1:
            now = materialize(now, "ranks")
    return now


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(``key``, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("by_rule", by_rule)
    lower = F.translate("html", _UPPER, _LOWER)
    pointed = split.where("host <> ''").select(F.col("host").alias("src"), F.array_distinct(F.regexp_extract_all(lower, F.lit(TARGET), F.lit(1))).alias("targets"), F.array_distinct(F.regexp_extract_all(lower, F.lit(MENTION), F.lit(0))).alias("mentions"))
    each = F.concat(F.transform("targets", lambda h: F.struct(h.alias("dst"), F.lit(True).alias("direct"))), F.transform(F.array_except("mentions", "targets"), lambda h: F.struct(h.alias("dst"), F.lit(False).alias("direct"))))
    links = pointed.select("src", F.inline(each)).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("direct").alias("direct"))
    links = materialize(links, "links")
    fetched = split.where("host <> ''").groupBy("host").agg((F.count_if(F.col("by_rule") == "allow") / F.count("*")).alias("good"), (F.count_if(F.col("by_rule") == "block") / F.count("*")).alias("bad"))
    home = fitting_rule(F.col("host"), F.lit("/"), rules)[1]
    only_linked = links.select(F.col("dst").alias("host")).distinct().join(fetched.select("host"), "host", "left_anti").select("host", home.alias("of_home")).where("of_home is not null")
    hosts = materialize(fetched.unionByName(only_linked.select("host", *((F.col("of_home") == what).cast("double").alias(c) for what, c in (("allow", "good"), ("block", "bad"))))), "hosts")
    # What only looks like a host, as version numbers and names of files do, is a link if there is such a host.
    meant = links.join(hosts.select(F.col("host").alias("dst"), F.lit(True).alias("known")), "dst", "left").where("direct or known").select("src", "dst", "n")
    found = ranks(meant, hosts)
    return (
        split.drop("html")
        .join(found, "host", "left")
        .select(
            key, "host", "path", "rule",
            F.coalesce("by_rule", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")).alias("verdict"),
            F.coalesce("trust", F.lit(0.0)).alias("trust"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        )
    )


def oracle() -> str:
    """The same as DuckDB SQL, with a table expression for each round."""
    fits = "(host = '{h}' OR suffix(host, '.{h}')) AND starts_with({path}, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

    def case(pick: Callable[[tuple[str, str, str]], str], path: str) -> str:
        return "CASE " + " ".join(f"WHEN {fits.format(h=r[1], p=r[2], path=path)} THEN '{pick(r)}'" for r in ordered) + " END"

    target = TARGET.replace("'", "''")
    parts = [
        f"""rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages),
split0 AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
split AS (SELECT *, {case(lambda r: r[1] + r[2], "path")} AS rule, {case(lambda r: r[0], "path")} AS by_rule FROM split0),
lower AS (SELECT host, translate(html, '{_UPPER}', '{_LOWER}') AS t FROM split WHERE host <> ''),
pointed AS (SELECT host AS src, list_distinct(regexp_extract_all(t, '{target}', 1)) AS targets, list_distinct(regexp_extract_all(t, '{MENTION}')) AS mentions FROM lower),
links AS (SELECT src, unnest(targets) AS dst, true AS direct FROM pointed UNION ALL SELECT src, unnest(list_filter(mentions, lambda x: NOT list_contains(targets, x))), false FROM pointed),
fetched AS (SELECT host, count(*) FILTER (by_rule = 'allow') / count(*) AS good, count(*) FILTER (by_rule = 'block') / count(*) AS bad FROM split WHERE host <> '' GROUP BY host),
others AS (SELECT host, {case(lambda r: r[0], "'/'")} AS of_home FROM (SELECT DISTINCT dst AS host FROM links WHERE src <> dst AND dst NOT IN (SELECT host FROM fetched))),
hosts AS (SELECT * FROM fetched UNION ALL SELECT host, (of_home = 'allow')::INT::DOUBLE, (of_home = 'block')::INT::DOUBLE FROM others WHERE of_home IS NOT NULL),
edges AS (SELECT src, dst, count(*) AS n, dst IN (SELECT host FROM hosts) AS known FROM links WHERE src <> dst GROUP BY src, dst HAVING bool_or(direct) OR known),
weighted AS (SELECT * FROM (SELECT src, dst, known, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM edges) WHERE known),
seeds AS (SELECT host, coalesce(round(good * count(*) OVER () / nullif(sum(good) OVER (), 0), {DIGITS}), 0) AS good, coalesce(round(bad * count(*) OVER () / nullif(sum(bad) OVER (), 0), {DIGITS}), 0) AS bad FROM hosts),
r0 AS (SELECT host, good AS trust, bad AS distrust FROM seeds)"""
    ]
    for k in range(ROUNDS):
        parts.append(
            f"""f{k} AS MATERIALIZED (SELECT host, sum(t)::DOUBLE AS t, sum(d)::DOUBLE AS d FROM (
  SELECT dst AS host, round(trust * forth, 15)::DECIMAL(35, 15) AS t, 0::DECIMAL(35, 15) AS d FROM weighted JOIN r{k} ON r{k}.host = src
  UNION ALL SELECT src, 0, round(distrust * back, 15)::DECIMAL(35, 15) FROM weighted JOIN r{k} ON r{k}.host = dst) GROUP BY host),
r{k + 1} AS MATERIALIZED (SELECT s.host, round({1 - DAMPING} * s.good + {DAMPING} * coalesce(t, 0), {DIGITS}) AS trust, round({1 - DAMPING} * s.bad + {DAMPING} * coalesce(d, 0), {DIGITS}) AS distrust FROM seeds s LEFT JOIN f{k} ON f{k}.host = s.host)"""
        )
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, split.host, path, rule, coalesce(by_rule, CASE WHEN distrust > {THRESHOLD} * trust THEN 'block' ELSE 'allow' END) AS verdict FROM split LEFT JOIN r{ROUNDS} r ON r.host = split.host"
