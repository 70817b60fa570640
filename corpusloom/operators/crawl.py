"""Crawl dataflow: request log reports, novelty, stop conditions, link scheduling, robots rules, frontier rounds."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators.running import moving_mean, running
from corpusloom.plans.session import settle

# The status labels of the report, in its order.
STATUS_LABELS = ("OK", "NotFound", "Redirect", "NoContent", "Forbidden", "BadRequest", "Moved")
RATE_MARGIN_MS = 20
MAX_ROBOTS_DELAY_MS = 5_000


@dataclass
class CrawlConfig:
    """The settings of a crawl; keys are read case-insensitively, one key=value a line, # for comments."""

    scope: str = "subdomain"
    rooturl: str = ""
    storagedir: str = ""
    maxduration: int = 0
    maxpagecount: int = 0
    maxerrorscount: int = 0
    minuniquetext: int = 10
    maxsizeondisk: int = 0
    mincrawldelay: int = 100
    excludeurls: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: list[str]) -> CrawlConfig:
        out = cls()
        for line in lines:
            key, sep, rest = line.strip().partition("=")
            if not sep or key.startswith("#"):
                continue
            key, value = key.strip().lower(), rest.split("=", 1)[0].strip()
            if key == "scope":
                out.scope, out.excludeurls = value.lower(), []
            elif key == "excludeurls":
                out.excludeurls.append(value)
            elif hasattr(out, key):
                setattr(out, key, int(value) if isinstance(getattr(out, key), int) else value)
            else:
                raise ValueError(f"Unknown parameter {key}")
        return out

    def render(self) -> list[str]:
        plain = [f"{k}={v}" for k, v in self.__dict__.items() if k != "excludeurls"]
        return plain + [f"excludeurls={p}" for p in self.excludeurls]


def requests_once(log: DataFrame) -> DataFrame:
    return log.dropDuplicates(["request_id"])


def status_pivot(log: DataFrame, sites: DataFrame) -> DataFrame:
    """Requests of every site by status label; sites without requests have zeros."""
    n = log.groupBy("siteindex").agg(
        F.count(F.lit(1)).alias("requests"), *(F.count_if(F.col("status_code") == s).alias(s.lower()) for s in STATUS_LABELS)
    )
    return sites.select("siteindex", "website").join(n, "siteindex", "left").drop("siteindex").na.fill(0)


def failed_requests(log: DataFrame) -> DataFrame:
    """Requests that count as errors: a message that isn't about a missing or moved page, or a failure status other than not found."""
    m = F.lower("error_message")
    by_message = F.col("error_message").isNotNull() & ~m.contains("not found") & ~m.contains("moved")
    by_status = F.col("status_code").isNotNull() & ~F.col("status_code").isin("OK", "NotFound", "Redirect", "Moved", "NoContent")
    return log.where(by_message | F.coalesce(by_status, F.lit(False)))


def last_requests(log: DataFrame, n: int = 10) -> DataFrame:
    """The last n requests of every site, newest first (a report)."""
    w = Window.partitionBy("siteindex").orderBy(F.desc("clock"), F.desc("request_id"))
    return log.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("siteindex", "place", "request_id", "url")


def crawl_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("siteindex").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") == "OK").alias("pages"),
        F.count_if(F.col("error_message").isNotNull()).alias("errors"),
        F.sum("content_size_bytes").alias("bytes"),
        F.sum("response_time_ms").alias("response_ms"),
        F.sum("download_time_ms").alias("download_ms"),
        F.max("crawl_depth").alias("depth"),
    )


def site_report(textdf: DataFrame, pages: DataFrame, log: DataFrame, sites: DataFrame) -> DataFrame:
    """Log rows, documents, elements and characters of every site in one pass a table."""
    count = lambda df, name: df.groupBy("siteindex").agg(F.count(F.lit(1)).alias(name))
    text = textdf.groupBy("siteindex").agg(F.count(F.lit(1)).alias("elements"), F.sum(F.length("text")).alias("characters"))
    out = sites.select("siteindex", "website")
    for part in (count(log, "log_rows"), count(pages, "documents"), text):
        out = out.join(part, "siteindex", "left")
    return out.drop("siteindex").na.fill(0)


def novelty(blocks: DataFrame) -> DataFrame:
    """(site, doc, chars, new_chars, ratio) of blocks(site, doc, pos, text): the share of a document's characters in texts its
    site has not had before, in order of (doc, pos); 1 without characters.

    The first place of every text is a partial aggregate; only it is joined back."""
    first = blocks.groupBy("site", "text").agg(F.min(F.struct("doc", "pos")).alias("f"))
    new = first.select("site", F.col("f.doc").alias("doc"), F.length("text").alias("n")).groupBy("site", "doc").agg(F.sum("n").alias("new_chars"))
    all_ = blocks.groupBy("site", "doc").agg(F.sum(F.length("text")).alias("chars"))
    out = all_.join(new, ["site", "doc"], "left").withColumn("new_chars", F.coalesce("new_chars", F.lit(0)))
    return out.select("site", "doc", "chars", "new_chars", F.when(F.col("chars") > 0, F.col("new_chars") / F.col("chars")).otherwise(F.lit(1.0)).alias("ratio"))


def moving_novelty(ratios: DataFrame, window: int = 1000) -> DataFrame:
    """Mean ratio of the last documents of each site, this one included."""
    return moving_mean(ratios.select("site", "doc", "ratio"), ["site"], [F.col("doc")], "ratio", window, "moving_ratio").select("site", "doc", "moving_ratio")


def first_stop(log: DataFrame, sites: DataFrame, max_errors: int = 20, window: int = 1000, max_minutes: int = 0, max_bytes: int = 0) -> DataFrame:
    """The first request of a site at which a stop condition holds, and which.

    Conditions in their order: duration in whole minutes since the site's first request (0: none), pages, errors, unique
    text below the site's minimum, size of what was downloaded (0: none)."""
    order = [F.col("clock"), F.col("request_id")]
    log = log.select("siteindex", "clock", "request_id", "status_code", "error_message", "unique_text_blocks_pct", "content_size_bytes")
    rows = moving_mean(log, ["siteindex"], order, "unique_text_blocks_pct", window, "unique_mean").drop("_i")
    ok, bad = F.coalesce(F.col("status_code") == "OK", F.lit(False)).cast("long"), F.col("error_message").isNotNull().cast("long")
    rows = running(rows, ["siteindex"], order, {"pages": ok, "errors": bad, "bytes": F.col("content_size_bytes")}, seq="seq")
    begun = log.groupBy("siteindex").agg(F.min("clock").alias("begun"))
    rows = rows.join(sites.select("siteindex", "maxpagecount", "minuniquetext"), "siteindex").join(begun, "siteindex")
    minutes = F.floor((F.unix_timestamp("clock") - F.unix_timestamp("begun")) / 60)
    reason = (
        F.when(F.lit(max_minutes > 0) & (minutes >= max_minutes), "duration")
        .when(F.col("pages") >= F.col("maxpagecount"), "pages")
        .when(F.col("errors") > max_errors, "errors")
        .when((F.col("seq") >= 10) & (F.col("unique_mean") * 100 < F.col("minuniquetext")), "unique")
        .when(F.lit(max_bytes > 0) & (F.col("bytes") >= max_bytes), "size")
    )
    hits = rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
    first = hits.groupBy("siteindex").agg(F.min(F.struct("seq", "reason", "request_id")).alias("f"))
    return first.select("siteindex", F.col("f.seq").cast("int").alias("seq"), "f.reason", "f.request_id")


def should_crawl(
    url: Column, root: Column, scope: Column, depth: Column, redirects: Column, max_depth: int = 100, max_redirects: int = 7,
    pages: Column | None = None, max_pages: int = 0, domain_pages: Column | None = None, max_domain_pages: int = 0,
) -> Column:
    """(allowed, reason) of a page before it is fetched; the first rule that refuses decides.

    ``pages`` and ``domain_pages`` are how many pages were crawled before, in all and of the page's domain; 0 allows any number."""
    no = lambda why: F.struct(F.lit(False).alias("allowed"), F.lit(why).alias("reason"))
    return (
        F.when(url.isNull() | (url == ""), no("no url"))
        .when(F.coalesce(redirects, F.lit(0)) > max_redirects, no("too many redirects"))
        .when(F.coalesce(depth, F.lit(0)) > max_depth, no("too deep"))
        .when(~urls.scheme(url).isin("http", "https"), no("scheme"))
        .when(F.lit(max_pages > 0) & (F.coalesce(pages if pages is not None else F.lit(0), F.lit(0)) >= max_pages), no("too many pages"))
        .when(F.lit(max_domain_pages > 0) & (F.coalesce(domain_pages if domain_pages is not None else F.lit(0), F.lit(0)) >= max_domain_pages), no("too many pages of the domain"))
        .when(~F.coalesce(urls.in_scope(url, root, scope), F.lit(False)), no("external"))
        .otherwise(F.struct(F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("reason")))
    )


def should_download(status: Column, content_type: Column, size: Column, max_size: int = 10_000_000) -> Column:
    kind = F.when(content_type.contains("html"), "Html").when(content_type.contains("pdf"), "Pdf")
    return F.when((status == "OK") & kind.isNotNull() & (F.coalesce(size, F.lit(0)) <= max_size), kind)


def should_recrawl(error: Column, retries: Column, max_retries: int = 3) -> Column:
    return error.isNotNull() & (F.coalesce(retries, F.lit(0)) < max_retries)


def nofollow_page(robots_value: Column) -> Column:
    v = F.lower(robots_value)
    return F.coalesce(v.contains("nofollow") | v.contains("none"), F.lit(False))


def nofollow_link(rel: Column) -> Column:
    return F.coalesce(F.trim(F.lower(rel)) == "nofollow", F.lit(False))


def rate_limited_starts(log: DataFrame, delay_ms: int = 100) -> DataFrame:
    """When every request of a host may start if each waits for the one before by the delay and a margin.

    start(i) = max over j <= i of clock(j) + (i - j) * delay, a running maximum."""
    step = delay_ms + RATE_MARGIN_MS
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(clock AS TIMESTAMP_NTZ))")
    order = [F.col("clock"), F.col("request_id")]
    placed = running(log.select("siteindex", "request_id", "clock", ms.alias("ms")), ["siteindex"], order, seq="n")
    rows = running(placed, ["siteindex"], order, maxima={"base": F.col("ms") - F.col("n") * step})
    return rows.select("siteindex", "request_id", (F.col("base") + F.col("n") * step).alias("start_ms"))


# robots rules


def robots_rules(lines: DataFrame) -> DataFrame:
    """(host, agent, patterns, delay, sitemaps) of robots files (host, content).

    Neighbouring user-agent lines share the rules below them; a repeated agent's rules are put together.
    Trailing question marks are cut and empty disallows have no effect."""
    rows = lines.select("host", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    cleaned = F.trim(F.substring_index("line", "#", 1))
    rows = rows.select("host", "at", F.lower(F.trim(F.regexp_extract(cleaned, r"^([^:]+):(.*)$", 1))).alias("name"), F.trim(F.regexp_extract(cleaned, r"^([^:]+):(.*)$", 2)).alias("value"))
    rows = rows.where(F.col("name").isin("user-agent", "disallow", "allow", "crawl-delay", "sitemap"))
    w = Window.partitionBy("host").orderBy("at")
    agent = F.col("name") == "user-agent"
    opens = agent & ~F.coalesce(F.lag("name").over(w) == "user-agent", F.lit(False))
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = rows.where(agent).select("host", "block", F.lower("value").alias("agent"))
    rules = rows.where(~agent)
    rule = F.when(F.col("name") == "disallow", F.regexp_replace("value", r"\?+$", ""))
    joined = agents.join(rules, ["host", "block"], "left")
    return joined.groupBy("host", "agent").agg(
        F.array_sort(F.collect_set(F.nullif(rule, F.lit("")))).alias("patterns"),
        F.max(F.when(F.col("name") == "crawl-delay", F.col("value").try_cast("double"))).alias("delay"),
        F.array_sort(F.collect_set(F.when(F.col("name") == "sitemap", F.col("value")))).alias("sitemaps"),
    )


def rule_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: a prefix, * for anything, $ for the end if it is last."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.replace(F.regexp_replace(body, r"([\\.^$|?+(){}\[\]])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), quoted, F.when(anchored, "$").otherwise(""))


def robots_allowed(url: Column, patterns: Column) -> Column:
    """Is the URL allowed?  Without rules all is; with rules robots.txt itself isn't; Allow lines are not considered."""
    target = F.concat(urls.path(url), urls.query(url))
    some = F.size(F.coalesce(patterns, F.array().cast("array<string>"))) > 0
    hit = F.exists(patterns, lambda p: F.regexp_like(target, rule_regex(p)))
    return F.when(~some, True).when(urls.path(url) == "/robots.txt", False).otherwise(~hit)


def crawl_delay_ms(delay_s: Column, minimum_ms: int) -> Column:
    """A robots delay counts up to its cap, and only if it is more than the minimum."""
    capped = F.least(delay_s * 1000, F.lit(MAX_ROBOTS_DELAY_MS)).cast("int")
    return F.when(capped > minimum_ms, capped).otherwise(minimum_ms)


# frontier


def new_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """links(url, ...) that aren't in known(url), each once, by their 64-bit key."""
    keyed = links.withColumn("key", urls.key64(F.col("url"))).dropDuplicates(["key"])
    return keyed.join(known.select(urls.key64(F.col("url")).alias("key")), "key", "left_anti").drop("key")


def frontier_depths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(url, depth) of all pages reachable from roots(url) over edges(source, target), breadth first.

    One round a level until a level has no new page (or as the crawl's setting allows); every round is a table in the shared folder, and known pages are left out by an anti join."""
    edges = settle(edges.where("source IS NOT NULL AND target IS NOT NULL").distinct())
    level = settle(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    known = level
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        found = level.join(edges, level["url"] == edges["source"]).select(F.col("target").alias("url")).distinct()
        level = settle(found.join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def should_crawl_links(content: Column, internal: Column, depth: Column, max_depth: int = 100) -> Column:
    """(allowed, reason) of following a fetched page's links."""
    no = lambda why: F.struct(F.lit(False).alias("allowed"), F.lit(why).alias("reason"))
    return (
        F.when(F.coalesce(F.trim(content), F.lit("")) == "", no("no content"))
        .when(~F.coalesce(internal, F.lit(False)), no("external"))
        .when(F.coalesce(depth, F.lit(0)) >= max_depth, no("too deep"))
        .otherwise(F.struct(F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("reason")))
    )


def is_internal(url: Column, root: Column, first_root: Column, scope: Column) -> Column:
    """Inside the scope of the current root, or of the root before a redirect."""
    return F.coalesce(urls.in_scope(url, root, scope), F.lit(False)) | F.coalesce(urls.in_scope(url, first_root, scope), F.lit(False))


def capped_links(links: DataFrame, most: int) -> DataFrame:
    """The first links(page, pos, url) of every page, as many as the crawl's setting allows; a setting of 0 allows all."""
    if not most:
        return links
    w = Window.partitionBy("page").orderBy("pos")
    return links.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def still_allowed(frontier: DataFrame, rules: DataFrame) -> DataFrame:
    """frontier(url, host) without what rules(host, patterns) forbid since a change of settings."""
    kept = frontier.join(rules.select("host", "patterns"), "host", "left")
    return kept.where(robots_allowed(F.col("url"), F.col("patterns"))).drop("patterns")


def next_batch(frontier: DataFrame, size: int) -> DataFrame:
    """The next entries of a frontier(url, crawl_depth, seq), first in first out within a depth (a report of fixed size)."""
    return frontier.orderBy("crawl_depth", "seq").limit(size)


def retry_times(log: DataFrame, minimum_ms: int = 5_000, max_retries: int = 3) -> DataFrame:
    """(request_id, retry_ms): when failed requests may be tried again: after their own delay, at least the minimum."""
    again = log.where(should_recrawl(F.col("error_message"), F.col("retry_count"), max_retries) & F.col("clock").isNotNull())
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(clock AS TIMESTAMP_NTZ))")
    own = F.when(~F.isnan("retry_after_s"), F.col("retry_after_s") * 1000)
    return again.select("request_id", (ms + F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(float(minimum_ms))).cast("bigint")).alias("retry_ms"))


def rechecked_errors(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """(url, logged, fresh) of requests that failed, beside a fresh status of the same address; null if there is none."""
    failed = log.where(F.col("status_code").isNotNull() & (F.col("status_code") != "OK")).select("url", F.col("status_code").alias("logged")).distinct()
    return failed.join(fresh.select("url", F.col("status_code").alias("fresh")), "url", "left")


def agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """(host, patterns, delay, sitemaps) for one agent: its own group, else that of *."""
    mine = rules.where((F.col("agent") == agent.lower()) | (F.col("agent") == "*"))
    best = mine.groupBy("host").agg(F.max_by(F.struct("patterns", "delay", "sitemaps"), F.col("agent") != "*").alias("r"))
    return best.select("host", "r.*")


def with_excludes(rules: DataFrame, excludes: DataFrame, agent: str = "bingbot") -> DataFrame:
    """agent_rules of hosts with extra patterns excludes(host, pattern) of the crawl's settings."""
    extra = excludes.where(F.col("pattern").isNotNull()).groupBy("host").agg(F.array_sort(F.collect_set("pattern")).alias("extra"))
    both = agent_rules(rules, agent).join(extra, "host", "full")
    none = F.array().cast("array<string>")
    return both.select("host", F.array_union(F.coalesce("patterns", none), F.coalesce("extra", none)).alias("patterns"), "delay", "sitemaps")


def allowed_under_root(url: Column, root: Column, patterns: Column) -> Column:
    """URLs outside the root of a robots file aren't its business; http and https are one."""
    plain = lambda c: F.regexp_replace(c, "^https?://", "")
    return F.when(~F.startswith(plain(url), plain(root)), True).otherwise(robots_allowed(url, patterns))


def observed_crawl(log: DataFrame, observation) -> DataFrame:
    """The log with its progress counted while it is used: requests, pages, errors, bytes, latest time."""
    return log.observe(
        observation,
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") == "OK").alias("pages"),
        F.count_if(F.col("error_message").isNotNull()).alias("errors"),
        F.sum("content_size_bytes").alias("bytes"),
        F.max("clock").alias("latest"),
    )


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter of n entries with false positive probability p."""
    import math

    bits = max(1, math.ceil(n * math.log(p) / math.log(1 / 2 ** math.log(2))))
    return bits, max(1, round(math.log(2) * bits / max(n, 1)))


def _bloom_bits(url: Column, bits: int, hashes: int) -> Column:
    """The bit numbers of an entry by double hashing."""
    a, b = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.shiftrightunsigned(a, 2) + i * F.shiftrightunsigned(b, 16), F.lit(bits)))


def bloom_filter(known: DataFrame, n: int = 2_000_001, p: float = 0.001) -> DataFrame:
    """(bit) set by known(url): an approximate set of fixed size for any number of entries."""
    bits, hashes = bloom_size(n, p)
    return known.where("url IS NOT NULL").select(F.explode(_bloom_bits(F.col("url"), bits, hashes)).alias("bit")).distinct()


def maybe_known(links: DataFrame, filter_bits: DataFrame, n: int = 2_000_001, p: float = 0.001) -> DataFrame:
    """(url) of the links all of whose bits are set: every known one, and of the others about one in 1/p."""
    bits, hashes = bloom_size(n, p)
    probes = links.where("url IS NOT NULL").select("url").distinct().select("url", F.explode(F.array_distinct(_bloom_bits(F.col("url"), bits, hashes))).alias("bit"))
    need = probes.groupBy("url").agg(F.count(F.lit(1)).alias("need"))
    hit = probes.join(filter_bits, "bit", "left_semi").groupBy("url").agg(F.count(F.lit(1)).alias("hit"))
    return need.join(hit, "url").where("hit = need").select("url")


# recorded fetches


def followed_redirects(log: DataFrame) -> DataFrame:
    """(request_id, url, root_replaced, cross_host) of a log(request_id, url, redirected_from, crawl_depth): a redirected
    root page replaces the root of its crawl; a redirect to another host is to be checked against the scope again."""
    moved = F.col("redirected_from").isNotNull() & (F.col("redirected_from") != F.col("url"))
    return log.where(moved).select(
        "request_id", "url", (F.coalesce("crawl_depth", F.lit(0)) == 0).alias("root_replaced"),
        (urls.host(F.col("url")) != urls.host(F.col("redirected_from"))).alias("cross_host"),
    )


def page_pipeline(fetched: DataFrame, known: DataFrame, sites: DataFrame, max_depth: int = 100) -> DataFrame:
    """One round of the page pipeline over recorded fetches: (siteindex, url, crawl_depth) to schedule next.

    fetched(siteindex, url, crawl_depth, status_code, links array<string>): pages answered OK give their links one level
    deeper, in the scope of the site (its root may have been replaced), without fragments, new to known(url), once each."""
    links = fetched.where((F.col("status_code") == "OK") & (F.coalesce("crawl_depth", F.lit(0)) < max_depth)).select(
        "siteindex", (F.coalesce("crawl_depth", F.lit(0)) + 1).alias("crawl_depth"), F.explode("links").alias("url")
    )
    links = links.withColumn("url", urls.without_fragment(F.col("url"))).where("url <> ''").join(sites.select("siteindex", "rooturl", "scope"), "siteindex")
    inside = links.where(F.coalesce(urls.in_scope(F.col("url"), F.col("rooturl"), F.col("scope")), F.lit(False)))
    first = inside.groupBy("siteindex", "url").agg(F.min("crawl_depth").alias("crawl_depth"))
    return first.join(known.select("url"), "url", "left_anti").select("siteindex", "url", "crawl_depth")


def new_exact(links: DataFrame, known: DataFrame) -> DataFrame:
    """links(url) that aren't in known(url), each once, by the whole address."""
    return links.where("url IS NOT NULL").select("url").distinct().join(known.select("url"), "url", "left_anti")


def resumed_frontier(frontier: DataFrame, done: DataFrame) -> DataFrame:
    """The entries of a saved frontier(url, ...) that are still to be fetched when a crawl goes on: not in done(url)."""
    return frontier.dropDuplicates(["url"]).join(done.select("url").distinct(), "url", "left_anti")


def agent_allowed_at_root(rules: DataFrame, agent: str) -> DataFrame:
    """(host, allowed): may the agent read the root of a host at all?"""
    mine = agent_rules(rules, agent)
    return mine.select("host", robots_allowed(F.concat(F.lit("http://"), F.col("host"), F.lit("/")), F.col("patterns")).alias("allowed"))


def progress_line(minutes: Column, pages: Column, errors: Column, unique: Column, size: Column) -> Column:
    """The status line of a crawl."""
    return F.concat_ws(
        " | ", F.concat(minutes.cast("string"), F.lit(" min")), F.concat(pages.cast("string"), F.lit(" pages")), F.concat(errors.cast("string"), F.lit(" errors")),
        F.concat(F.format_string("%d", F.floor(unique * 100)), F.lit(" % unique")), F.concat(F.format_string("%.1f", size / 1048576.0), F.lit(" MB")),
    )
