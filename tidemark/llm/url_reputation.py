"""URL filters: host and path rules, and empirical-Bayes reputation of hosts, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, n_words, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a level's share of variance: below, its groups are as one; above, they tell nothing of each other.
RHO = (0.001, 0.9)
#: That share where no group has two outcomes to tell it.
UNKNOWN_RHO = 0.1


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null and where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null and where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Suffixes of two labels under which names are registered; a shortened list, callers give a longer one.
SUFFIXES = ("ac.jp", "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "go.jp", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^[0-9.]+$|^\[")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: one label before the host's suffix, without user and port. A host of one label is its own,
    and so is a numeric address."""
    bare = _bare(host)
    three, two = F.substring_index(bare, ".", -3), F.substring_index(bare, ".", -2)
    return F.when(_is_address(bare), bare).when(two.isin(list(suffixes)), three).otherwise(two)


def suffix_of(domain: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last label of a domain, or the last two where they are in the list; a numeric address is its own."""
    two = F.substring_index(domain, ".", -2)
    return F.when(_is_address(domain), domain).when(two.isin(list(suffixes)), two).otherwise(F.substring_index(domain, ".", -1))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does. Rules are (block or allow, host with path from
    its first slash); a rule fits its host and all subdomains where the path starts with the rule's. The list is part of
    the plan, so it is for lists of hundreds."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


#: A good page's text: words at least, and of its characters the share of symbols, capitals and links' text at most.
LEAST_WORDS, MOST_SYMBOLS, MOST_CAPITALS, MOST_LINKS = 50, 0.02, 0.3, 0.5
_TAGS = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"
_LINK = r"(?is)<a\b[^>]*>(.*?)</a>"
#: What begins a part that goes with its content, letters of the same number in its place, and what ends that part.
_PARTS = ((r"(?i)<script\b", "<xcript", "</script>"), (r"(?i)<style\b", "<xtyle", "</style>"), ("<!--", "<x--", "-->"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split_at(html: Column, last: str, use: Callable[[Column, Column], Column]) -> Column:
    """use of html up to and with the last place of `last` (in any case of letters), and of what follows."""
    return _let(html, lambda whole: _let(F.regexp_extract(whole, f"(?is)^.*{last}", 0), lambda head: use(head, F.substr(whole, F.length(head) + 1))))


def without_tags(html: Column) -> Column:
    """html with a blank for each match of _TAGS, in time that grows with its length.

    The pattern alone would look to the end of the page for each beginning that has no end. So beginnings behind the last
    end of their kind are made plain tags first, which is what the pattern takes them for, and what is behind the last >
    is left as it is; then wherever the pattern begins it ends, and goes on from there."""
    own = html
    for begin, stand_in, end in _PARTS:
        own = _split_at(own, end, lambda head, rest, b=begin, s=stand_in: F.concat(head, F.regexp_replace(rest, b, s)))
    ends = F.length(html) - F.length(F.substring_index(html, ">", -1))  # 0 without any
    return F.concat(F.regexp_replace(F.left(own, ends), _TAGS, " "), F.substr(html, ends + 1))


def link_text(html: Column) -> Column:
    """The texts of html's links, as _LINK finds them, with blanks between. As above, in linear time: what is behind the
    last </a> has no link, and no link begins behind the last > before that. An A there can come out as another letter."""
    before = F.regexp_extract(html, "(?is)^(.*)</a>", 1)
    links = _split_at(before, ">", lambda head, rest: F.concat(head, F.regexp_replace(rest, r"(?i)<a\b", "<b"), F.lit("</a>")))
    return F.array_join(F.regexp_extract_all(links, F.lit(_LINK), F.lit(1)), " ")


def good_page(html: Column) -> Column:
    """1 if a page's text outside of tags, scripts and styles is prose by the shares above, else 0; null for a null page.
    Callers with labelled pages give that column to judge() instead. Its time is linear in a page's length, whatever tags
    the page opens and doesn't close."""
    size = lambda text, without: F.length(F.regexp_replace(text, without, ""))

    def prose(text: Column) -> Column:
        few = lambda what, share: size(text, f"[^{what}]+") <= share * size(text, BLANKS)
        links = size(_let(link_text(html), without_tags), BLANKS) <= MOST_LINKS * size(text, BLANKS)
        return (n_words(text) >= LEAST_WORDS) & few("#*$%&|<>{}", MOST_SYMBOLS) & few("A-Z", MOST_CAPITALS) & links

    return F.when(html.isNotNull(), _let(without_tags(html), prose).cast("int"))


def _rho(groups: DataFrame, mean: str) -> float:
    """Moments of the beta-binomial: how much of the variance of outcomes is between groups of the same parent."""
    own = F.col("good") / F.col("n") - F.col(mean)
    binomial = F.col(mean) * (1 - F.col(mean))
    row = groups.where("n > 0").agg(F.sum(F.col("n") * own * own - binomial), F.sum(binomial * (F.col("n") - 1))).first()
    return min(max(row[0] / row[1] if row[1] else UNKNOWN_RHO, RHO[0]), RHO[1])


def reputation(outcomes: DataFrame, z: float = 3.0, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, good, mean, upper, all_mean) of every host in outcomes (host, outcome 1, 0 or null; nulls don't count).

    A suffix's mean is shrunk to that of all pages (with one good and one bad page added, so that it is no certainty), a
    registered domain's to its suffix's, and the host's posterior is a beta distribution whose prior has its domain's
    mean; the strengths of the three priors come from the data by the beta-binomial's moments. upper is the posterior
    mean plus z standard deviations, all_mean the mean of all pages. Outcomes are summed by host before they are
    shuffled, so a host with a third of the pages costs no more than others; what follows is as long as the list of hosts.
    """
    hosts = outcomes.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("good"))
    hosts = stage(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("domain"), suffixes)), "hosts")
    total = lambda by: hosts.groupBy(by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    if not n:  # without outcomes all hosts are as good as they can be
        return hosts.select("host", "n", "good", F.lit(1.0).alias("mean"), F.lit(1.0).alias("upper"), F.lit(1.0).alias("all_mean"))
    rate = lambda g: g.withColumn("rate", F.col("good") / F.nullif(F.col("n"), F.lit(0)))
    strength = lambda rho: 1 / rho - 1
    suffixes = total("suffix").withColumn("parent", F.lit((good + 1) / (n + 2)))
    k = strength(_rho(suffixes, "parent"))
    suffixes = rate(suffixes).withColumn("suffix_mean", (F.col("good") + k * F.col("parent")) / (F.col("n") + k))
    above = suffixes.select("suffix", F.coalesce("rate", "parent").alias("parent"), "suffix_mean")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(above, "suffix")
    k = strength(_rho(domains, "parent"))
    domains = rate(domains).withColumn("domain_mean", (F.col("good") + k * F.col("suffix_mean")) / (F.col("n") + k))
    above = domains.select("domain", F.coalesce("rate", "parent").alias("parent"), "domain_mean")
    hosts = hosts.join(above, "domain")
    k = strength(_rho(hosts, "parent"))
    a, b = F.col("good") + k * F.col("domain_mean"), F.col("n") - F.col("good") + k * (1 - F.col("domain_mean"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "good", (a / (a + b)).alias("mean"), (a / (a + b) + z * deviation).alias("upper"), F.lit((good + 1) / (n + 2)).alias("all_mean"))


def judge(pages: DataFrame, outcome: Column, rules: Sequence[tuple[str, str]], share: float = 0.8, z: float = 3.0, id_col: str = "page_id", url_col: str = "url", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, upper) of every row of pages. verdict is the longest fitting rule's,
    else block for hosts whose share of good pages is, even at the upper posterior bound, below `share` of that of all
    pages, else allow. So hosts are blocked for being worse than the rest, whatever the rest is like.

    A null url, or one without ://, has an empty host and path; such rows share one reputation. Rows that repeat an id
    are pages like others; an empty table gives an empty result.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    known = stage(reputation(pages.select(host.alias("host"), outcome.cast("long").alias("outcome")), z, suffixes), "reputation")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.join(known.select("host", "mean", "upper", "all_mean"), "host")
    own = F.when(F.col("upper") < share * F.col("all_mean"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mean", "upper")


def oracle(pages: str, rules: Sequence[tuple[str, str]], share: float = 0.8, z: float = 3.0) -> str:
    """The query over pages in one statement."""
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    by_length = sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)
    case = lambda give: "CASE " + " ".join(f"WHEN {fits(text)} THEN '{give(what, text)}'" for what, text in by_length) + " END"
    rho = lambda table: f"(SELECT coalesce(1 / least(greatest(sum(n * (good / n - parent) * (good / n - parent) - parent * (1 - parent)) / nullif(sum(parent * (1 - parent) * (n - 1)), 0), {RHO[0]}), {RHO[1]}), {1 / UNKNOWN_RHO}) - 1 FROM {table} WHERE n > 0)"
    link = _LINK.removeprefix('(?is)')
    tags, address, listed = _TAGS.removeprefix('(?is)'), r"regexp_matches(bare, '^[0-9.]+$|^\[')", ", ".join(f"'{x}'" for x in SUFFIXES)
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_replace(html, '{tags}', ' ', 'gis') AS text,
         regexp_replace(array_to_string(regexp_extract_all(html, '{link}', 1, 'is'), ' '), '{tags}', ' ', 'gis') AS linked
  FROM {pages}),
c AS (SELECT *, length(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS chars FROM u),
o AS (SELECT page_id, host, path, (len(regexp_extract_all(text, '[^ \t-\r]+')) >= {LEAST_WORDS} AND length(regexp_replace(text, '[^#*$%&|<>{{}}]+', '', 'g')) <= {MOST_SYMBOLS}::DOUBLE * chars
        AND length(regexp_replace(text, '[^A-Z]+', '', 'g')) <= {MOST_CAPITALS}::DOUBLE * chars AND length(regexp_replace(linked, '[ \t-\r]+', '', 'g')) <= {MOST_LINKS}::DOUBLE * chars)::INT AS outcome FROM c),
h AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare, count(outcome)::DOUBLE AS n, coalesce(sum(outcome), 0)::DOUBLE AS good FROM o GROUP BY host),
b AS (SELECT *, regexp_extract(bare, '([^.]*\.)?[^.]*$') AS two FROM h),
x AS (SELECT *, CASE WHEN {address} THEN bare WHEN two IN ({listed}) THEN regexp_extract(bare, '([^.]*\.)?[^.]*\.[^.]*$') ELSE two END AS domain,
        CASE WHEN {address} THEN bare WHEN two IN ({listed}) THEN two ELSE regexp_extract(bare, '[^.]*$') END AS suffix FROM b),
e AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS all_mean FROM x),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT all_mean FROM e) AS parent FROM x GROUP BY suffix),
s2 AS (SELECT suffix, coalesce(good / nullif(n, 0), parent) AS rate, (good + {rho('s')} * parent) / (n + {rho('s')}) AS mean FROM s),
d AS (SELECT domain, suffix, sum(x.n) AS n, sum(x.good) AS good, any_value(s2.rate) AS parent, any_value(s2.mean) AS above FROM x JOIN s2 USING (suffix) GROUP BY domain, suffix),
d2 AS (SELECT domain, coalesce(good / nullif(n, 0), parent) AS rate, (good + {rho('d')} * above) / (n + {rho('d')}) AS mean FROM d),
g AS (SELECT x.*, d2.rate AS parent, d2.mean AS above FROM x JOIN d2 USING (domain)),
p AS (SELECT host, good + {rho('g')} * above AS a, n - good + {rho('g')} * (1 - above) AS b FROM g),
v AS (SELECT host, CASE WHEN a / (a + b) + {float(z)} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {float(share)}::DOUBLE * (SELECT all_mean FROM e) THEN 'block' ELSE 'allow' END AS own FROM p)
SELECT page_id, host, path, {case(lambda what, text: text)} AS rule, coalesce({case(lambda what, text: what)}, own) AS verdict
FROM o JOIN v USING (host)"""
