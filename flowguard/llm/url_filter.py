"""URL filter by propagation over the host graph, in built-in functions only.

Explicit rules decide the urls they fit. The hosts they decide are seeds: by how many of its pages a
rule allows, a host is trusted; by how many a rule blocks, it is blocked. Trust flows along the edges
as personalised PageRank from the trusted seeds; distrust flows against them (who links to a blocked
host is suspect) as PageRank on the reversed edges from the blocked seeds. A host whose distrust exceeds
its trust by ``MARGIN`` times the mean share of a host is blocked, all others are allowed; the verdict
holds for those of its urls that no rule fits.

Edges go from the host of a page to the hosts of absolute links in its html, by the number of links,
and both ways between a host and its parent domain (the host without its first label, if two labels are left), by
the host's pages. Edges and seeds are pre-aggregated, so a host with very many pages or links is a row
like any other; joins by host are left to adaptive execution, which splits skewed ones. Scores are
integers (shares of ``MASS``), so the result does not depend on the order of additions. The table of
a round is written to the shared folder. Mass that reaches a host without edges ends there.

Defined results: a null url or one without "://" has empty host and path, fits no rule and is allowed;
null html has no links; equal rows are judged each; no seeds give no scores. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import materialize, spare

ROUNDS = 8
MASS = 10**9
#: Share of the mass that follows edges, in hundredths.
FOLLOW = 85
MARGIN = 1
LINK = r"""(?i)(?:href|src)\s{0,8}=\s{0,8}["']?[a-z][a-z0-9+.-]{0,31}://([^/?#"'\\\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first "://", or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule], of) -> Column:
    """``of(rule)`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(of(r))).otherwise(found)
    return found


def edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts, and steps between a host and its parent domain."""
    here = pages.select(host_of(F.col(url)).alias("src"), F.col(html).alias("html")).where("src != ''")
    there = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower)
    linked = here.select("src", F.explode(there).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = here.groupBy("src").agg(F.count("*").alias("n"))
    parent = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.([^.]+\..+)$", 1).alias("dst"), "n").where("dst != ''")
    back = parent.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    every = linked.unionByName(parent).unionByName(back).where("src != dst")
    return every.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass) after some rounds of PageRank from ``seeds`` (kind, host, mass).

    ``links`` are (kind, src, dst, n); the kinds are separate graphs that share the jobs.
    """
    total = links.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    links = materialize(links.join(total, ["kind", "src"]), "hosts-links")
    seeds = materialize(seeds, "hosts-seeds")
    mass = seeds
    for _ in range(rounds):
        sent = links.join(mass.withColumnRenamed("host", "src"), ["kind", "src"])
        share = F.expr("(mass div total) * n + ((mass % total) * n) div total")
        got = sent.select("kind", F.col("dst").alias("host"), share.alias("got"), F.lit(0).cast("long").alias("seed"))
        own = seeds.select("kind", "host", F.lit(0).cast("long").alias("got"), F.col("mass").alias("seed"))
        both = got.unionByName(own).groupBy("kind", "host").agg(F.sum("got").alias("got"), F.sum("seed").alias("seed"))
        step = both.select("kind", "host", F.expr(f"({100 - FOLLOW} * seed + {FOLLOW} * got) div 100").alias("mass"))
        mass = materialize(step, "hosts-mass")
    return mass


def judge_hosts(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", html: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust, verdict) of every host of a page or a link."""
    place = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).where("host != ''")
    verdict = ruled(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    decided = place.select("host", verdict.alias("verdict")).groupBy("host", "verdict").agg(F.count("*").alias("n"))
    decided = materialize(decided, "hosts-decided")
    kinds = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust")
    ruled_ = decided.where("verdict IS NOT NULL").select(kinds.alias("kind"), "host", "n")
    total = ruled_.groupBy("kind").agg(F.sum("n").alias("total"))
    # two rows at most
    seeds = ruled_.join(F.broadcast(total), "kind").select("kind", "host", F.expr(f"n * {MASS} div total").alias("mass"))
    links = materialize(edges(pages, url, html), "hosts-edges")
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    reverse = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    mass = propagate(forward.unionByName(reverse), seeds, rounds)
    hosts = decided.select("host").unionByName(links.select(F.col("dst").alias("host"))).unionByName(links.select(F.col("src").alias("host")))
    empty = hosts.select("host", F.lit(0).cast("long").alias("trust"), F.lit(0).cast("long").alias("distrust"))
    scored = mass.select("host", F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0).alias("trust"),
                         F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0).alias("distrust"))
    scores = empty.unionByName(scored).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    scores = materialize(scores, "hosts-scores")
    limit = (F.col("distrust") - F.col("trust")) * scores.count() > MARGIN * MASS
    return scores.select("host", "trust", "distrust", F.when(limit, "block").otherwise("allow").alias("verdict"))


def mark(pages: DataFrame, into: str, rules: Sequence[Rule] = RULES, url: str = "url", html: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """``pages`` with a struct ``into`` of host, path, rule and verdict."""
    key, verdict = spare(pages, f"{into}_host"), spare(pages, f"{into}_verdict")
    hosts = judge_hosts(pages, rules, url, html, rounds).select(F.col("host").alias(key), F.col("verdict").alias(verdict))
    rows = pages.withColumn(key, host_of(F.col(url))).join(hosts, key, "left")
    path = path_of(F.col(url))
    rule = ruled(F.col(key), path, rules, lambda r: r.name)
    by_rule = ruled(F.col(key), path, rules, lambda r: r.verdict)
    out = F.struct(
        F.col(key).alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(by_rule, F.col(verdict), F.lit("allow")).alias("verdict")
    )
    return rows.select(*[F.col(c) for c in pages.columns], out.alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    from flowguard.llm.common import table

    found = mark(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "found")
    f = F.col("found")
    return found.select("page_id", f.host.alias("host"), f.path.alias("path"), f.rule.alias("rule"), f.verdict.alias("verdict"))


def oracle() -> str:
    """The same in DuckDB SQL, the rounds written out."""
    low = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    case, names = "", ""
    for r in sorted(RULES, key=lambda r: -len(r.name)):
        fits = f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        case += f" WHEN {fits} THEN '{r.verdict}'"
        names += f" WHEN {fits} THEN '{r.name}'"
    link = LINK.replace("'", "''")
    rounds = ["m0 AS (SELECT * FROM seeds)"]
    for k in range(ROUNDS):
        rounds.append(f"""got{k} AS (
  SELECT w.kind, dst AS host, (mass // total) * n + ((mass % total) * n) // total AS got, 0 AS seed FROM w JOIN m{k} ON w.kind = m{k}.kind AND w.src = m{k}.host
  UNION ALL SELECT kind, host, 0, mass FROM seeds
), m{k + 1} AS (
  SELECT kind, host, CAST(({100 - FOLLOW} * sum(seed) + {FOLLOW} * sum(got)) // 100 AS BIGINT) AS mass FROM got{k} GROUP BY kind, host
)""")
    return f"""
WITH u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, html, coalesce({low.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), j AS (SELECT page_id, html, host, path, CASE {case} END AS own, CASE {names} END AS rule FROM p),
decided AS (SELECT host, own, count(*) AS n FROM j WHERE host != '' GROUP BY host, own),
s0 AS (SELECT CASE WHEN own = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, n FROM decided WHERE own IS NOT NULL),
seeds AS (SELECT kind, host, CAST(n * {MASS} // sum(n) OVER (PARTITION BY kind) AS BIGINT) AS mass FROM s0),
l AS (
  SELECT host AS src, {low.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst, 1 AS n FROM p WHERE host != ''
), up AS (
  SELECT host AS src, regexp_extract(host, '^[^.]+\\.([^.]+\\..+)$', 1) AS dst, count(*) AS n FROM p WHERE host != '' GROUP BY host
), e AS (
  SELECT src, dst, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT * FROM l UNION ALL SELECT * FROM up WHERE dst != '' UNION ALL SELECT dst, src, n FROM up WHERE dst != ''
  ) WHERE src != dst GROUP BY src, dst
), w0 AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY kind, src) AS BIGINT) AS total FROM w0),
{", ".join(rounds)},
scores AS (
  SELECT host, sum(t) AS trust, sum(d) AS distrust FROM (
    SELECT host, 0 AS t, 0 AS d FROM decided UNION ALL SELECT dst, 0, 0 FROM e UNION ALL SELECT src, 0, 0 FROM e
    UNION ALL SELECT host, CASE WHEN kind = 'trust' THEN mass ELSE 0 END, CASE WHEN kind = 'distrust' THEN mass ELSE 0 END FROM m{ROUNDS}
  ) GROUP BY host
), judged AS (
  SELECT host, CASE WHEN (distrust - trust) * (SELECT count(*) FROM scores) > {MARGIN} * {MASS} THEN 'block' ELSE 'allow' END AS verdict FROM scores
)
SELECT page_id, j.host, path, rule, coalesce(own, verdict, 'allow') AS verdict FROM j LEFT JOIN judged ON j.host = judged.host
"""
