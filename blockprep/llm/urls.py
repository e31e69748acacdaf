"""URL filtering by pattern rules that are indexed by their rarest literal token.

Two lists are judged in one pass.  Site rules (``example.com/en/``) fit a host, all its
subdomains, and paths that start with the rule's.  Pattern rules use a small syntax: ``||`` in
front stands for the start of the host or of a label of it, ``|`` in front or behind for the
start or end of the URL (behind its ``://``), ``*`` for anything, ``^`` for a character other
than letters, digits and ``_-.%``, or the end; all else is literal.  Hosts are matched in lower
case (A-Z), the rest as it stands.

A literal token of a rule is a run of letters and digits that any fitting URL must hold as a
whole token of its own.  How often each such token occurs in the URLs is counted first; a rule
is filed under its rarest one (ties: the longer, then the smaller), and a URL's tokens fetch the
rules filed under them: only these run their regular expressions.  Rules without a whole
token are filed under the empty token, which every URL has.

The longest fitting site rule decides, else the longest fitting pattern, else ``default``;
of equally long ones, ``block`` wins, then the greater text.  A URL that is NULL, empty or
without ``://`` has an empty host and path; it fits no rule, and neither does one with nothing behind
``://``.  Rows that repeat are judged each
for itself, an empty table gives no rows, and columns named like a new one are replaced.  A URL
of any length is one row; nothing is cut.  Equal URLs are judged once per ``SPREAD`` shares of
their rows, so that a URL with a large part of all rows is no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares that the rows of one URL are dealt into.
SPREAD = 64
#: Rule lists up to this length are broadcast; longer ones meet the tokens by shuffle.
BROADCAST_RULES = 100_000

_TOKEN = "[a-z0-9]+"
_BEFORE_HOST = r"^(?:[^/?#]*\.)?"
_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\z)"
#: Marks a place where a fitting URL may go on with letters or digits.
_OPEN = "\u0001"


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A list of (rule, ``allow`` or ``block``) as a table."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\.+*?(){}\[\]$^|]", r"\\$0")


def _site_rules(rules: DataFrame) -> DataFrame:
    host = F.regexp_extract("rule", "^[^/]*", 0)
    rule = F.concat(_lower(host), F.substring(F.col("rule"), F.length(host) + 1, F.length("rule")))
    return rules.select(
        "rule",
        "verdict",
        F.lit(1).alias("site"),
        F.concat(F.lit("(?s)" + _BEFORE_HOST), _escaped(rule)).alias("regex"),
        F.concat(F.lit(" "), _lower(F.col("rule")), F.lit(_OPEN)).alias("shape"),
    )


def _pattern_rules(rules: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("rule", r"^\|\|?", ""), r"\|$", "")
    by_host, at_start, at_end = F.col("rule").startswith("||"), F.col("rule").startswith("|"), F.col("rule").endswith("|")
    regex = reduce(
        lambda text, step: F.replace(text, F.lit(step[0]), F.lit(step[1])),
        [(r"\*", ".*"), (r"\^", _SEPARATOR)],
        _escaped(body),
    )
    first = F.when(by_host, _BEFORE_HOST).when(at_start, "^").otherwise("")
    shape = F.translate(F.regexp_replace(body, r"\*", _OPEN), "^", " ")
    return rules.select(
        "rule",
        "verdict",
        F.lit(0).alias("site"),
        F.concat(F.lit("(?s)"), first, regex, F.when(at_end, r"\z").otherwise("")).alias("regex"),
        F.concat(F.when(at_start, " ").otherwise(_OPEN), _lower(shape), F.when(at_end, " ").otherwise(_OPEN)).alias("shape"),
    )


def compiled(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rules as (rule, verdict, site, regex, tokens); empty and NULL ones are left out."""
    both = _site_rules(rules).unionByName(_pattern_rules(patterns)).where("rule <> '' AND verdict IS NOT NULL")
    whole = rf"(?<![a-z0-9{_OPEN}])[a-z0-9]+(?![a-z0-9{_OPEN}])"
    tokens = F.array_distinct(F.regexp_extract_all("shape", F.lit(whole), F.lit(0)))
    return both.withColumn("tokens", tokens).drop("shape").distinct()


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and all behind the host."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    return _lower(host), F.regexp_extract(rest, "^[^?#]*", 0), rest


def _url_tokens(target: Column) -> Column:
    found = F.regexp_extract_all(_lower(target), F.lit(_TOKEN), F.lit(0))
    return F.explode(F.array_distinct(F.concat(found, F.array(F.lit("")))))


def rarest_tokens(rules: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """Add ``token``: the literal token of each rule that is rarest in ``targets`` (column target)."""
    literal = rules.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    wanted = literal.select("token").where("token <> ''").distinct()
    counted = (
        targets.select(_url_tokens(F.col("target")).alias("token"))
        .join(F.broadcast(wanted) if small else wanted, "token")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")
    return (
        literal.join(counted, "token", "left")
        .groupBy("rule", "verdict", "site", "regex")
        .agg(F.min_by("token", rank).alias("token"))
    )


def filter_urls(
    df: DataFrame,
    rules: DataFrame,
    patterns: DataFrame,
    url: str = "url",
    spread_by: str | None = None,
    default: str = "allow",
) -> DataFrame:
    """Add host, path, rule, pattern, verdict: what the longest fitting rule says of each URL.

    ``rule`` is the site rule and ``pattern`` the pattern that decided, or NULL.  ``spread_by``
    names a column by which the rows of one URL are dealt into shares, usually an id.
    """
    names = df.columns
    own = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = F.col(f"c{names.index(url)}")
    spread = F.pmod(F.xxhash64(f"c{names.index(spread_by)}"), F.lit(SPREAD)) if spread_by else F.lit(0)
    host, path, rest = _parts(at)
    target = F.concat(host, rest)

    made = compiled(rules, patterns)
    small = made.count() <= BROADCAST_RULES
    judgeable = own.where(F.length(target) > 0)
    index = rarest_tokens(made, judgeable.select(target.alias("target")), small)

    urls = judgeable.select(at.alias("u"), spread.alias("s")).distinct()
    uhost, _, urest = _parts(F.col("u"))
    asked = urls.select("u", "s", F.concat(uhost, urest).alias("target"))
    asked = asked.withColumn("token", _url_tokens(F.col("target")))
    fits = asked.join(F.broadcast(index) if small else index, "token").where(F.rlike("target", F.col("regex")))
    best = F.max(F.struct("site", F.length("rule").alias("n"), F.col("verdict") == "block", "verdict", "rule"))
    judged = fits.groupBy("u", "s").agg(best.alias("best"))

    joined = own.withColumns({"u": at, "s": spread}).join(judged, ["u", "s"], "left")
    site = F.col("best.site") == 1
    new = {
        "host": F.coalesce(host, F.lit("")),
        "path": F.coalesce(path, F.lit("")),
        "rule": F.when(site, F.col("best.rule")),
        "pattern": F.when(~site, F.col("best.rule")),
        "verdict": F.coalesce("best.verdict", F.lit(default)),
    }
    kept = [F.col(f"c{i}").alias(name) for i, name in enumerate(names) if name.lower() not in new]
    return joined.select(*kept, *[column.alias(name) for name, column in new.items()])
