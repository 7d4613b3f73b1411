"""URL verdicts: host and path rules first, pattern rules indexed by their rarest token else.

Pattern rules are written as in common block lists: ``*`` any characters, ``^`` a
separator or the end, ``||`` the beginning of a host or of a label in it, ``|`` the
beginning or end, ``@@`` in front an exception.  A token is a run of letters and digits
that every matching address holds as a whole run.  The corpus counts the tokens that any
rule has; each rule is filed under its rarest.  An address looks its own tokens up in
that index, a hash table of constant size in the plan, and only what it finds runs as a
regular expression.  No row moves between tasks but the counts of the rules' tokens.  A
list of more than LITERAL rules is a table instead, which the addresses' tokens are joined with.
"""

from __future__ import annotations

import re
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import ROW, numbered, table

# The host and path rules of the query's contract.
HOST_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
PATTERN_RULES = (
    "||free-bets.", "||casino.", "||adserver.", "||doubleclick.", "^banner^", "^ads^", "^sponsored^", "^popunder^", "^utm_source=", "^utm_medium=", "^utm_campaign=", "^sessionid=", "^phpsessid=",
    "^affiliate=", "^login^", "^signup^", "^cart^", "^wp-admin^", ".jpg|", ".png|", ".zip|", ".exe|", "@@^utm_source=feed^", "@@^rss^",
)
#: Rules up to which the index is a constant of the plan.
LITERAL = 500


def to_regex(rule: str) -> str:
    """The rule, without its ``@@``, as an expression that both engines understand."""
    body = rule.removeprefix("@@")
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        body, tail = body[:-1], r"\z"
    each = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\z)"}
    return "(?s)" + head + "".join(each.get(c, re.escape(c)) for c in body) + tail


def tokens(rule: str) -> list[str]:
    """Runs of letters and digits that stand between characters of another kind."""
    body = rule.removeprefix("@@")
    start = body.startswith("|")
    body = body.lstrip("|")
    end = body.endswith("|")
    body = body.rstrip("|")
    out = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = body[m.start() - 1] != "*" if m.start() else start
        right = body[m.end()] != "*" if m.end() < len(body) else end
        if left and right:
            out.append(m.group())
    return sorted(set(out))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def _looked_up(pages: DataFrame, pattern_rules, url: Column) -> Column:
    """The rules that fit, by an index that is a constant of the plan."""
    named = {r: tokens(r) for r in pattern_rules}
    known = sorted({t for v in named.values() for t in v})
    seen: dict[str, int] = {}
    if known:  # at most as many rows as the rules have tokens
        rows = pages.select(F.explode(F.array_intersect(_tokens_of(url), F.array(*map(F.lit, known)))).alias("t")).groupBy("t").count().collect()
        seen = {r["t"]: r["count"] for r in rows}
    buckets = 1 << max(2, (2 * len(pattern_rules)).bit_length())
    filed: dict[int, dict[str, list[str]]] = {}
    loose = []
    for r, ts in named.items():
        if ts:
            t = min(ts, key=lambda t: (seen.get(t, 0), t))
            filed.setdefault(crc32(t.encode()) % buckets, {}).setdefault(t, []).append(r)
        else:
            loose.append(r)
    entry = lambda r: F.struct(F.lit(r).alias("rule"), F.lit(to_regex(r)).alias("pattern"))
    none = "array<struct<rule:string,pattern:string>>"
    empty = F.array().cast(none)
    slots = [F.create_map(*(x for t, rs in filed[b].items() for x in (F.lit(t), F.array(*map(entry, rs)).cast(none)))) if b in filed else F.create_map().cast(f"map<string,{none}>") for b in range(buckets)]
    index = F.array(*slots)
    slot = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(buckets)).cast("int")
    found = F.flatten(F.transform(F.coalesce(_tokens_of(url), F.array().cast("array<string>")), lambda t: F.coalesce(F.element_at(F.element_at(index, slot(t) + 1), t), empty)))
    if loose:
        found = F.concat(found, F.array(*map(entry, loose)).cast(none))
    return F.transform(F.filter(found, lambda r: F.expr("true") & F.regexp(_lower(url), r["pattern"])), lambda r: r["rule"])


def _joined(pages: DataFrame, pattern_rules, url: Column) -> DataFrame:
    """``pages`` with ``patterns``, the rules that fit, by joining tokens with the table of rules.

    A rule without a token is filed under the empty one, which every address has.
    """
    spark = pages.sparkSession
    rules = spark.createDataFrame([(r, to_regex(r), tokens(r)) for r in pattern_rules], "rule string, pattern string, tokens array<string>").distinct()
    rows = numbered(pages)
    met = rows.select(ROW, url.alias("u"), F.explode(F.array_append(F.coalesce(_tokens_of(url), F.array().cast("array<string>")), F.lit(""))).alias("t"))
    each = rules.select("rule", "pattern", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("t"))
    seen = met.select("t").join(each.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    filed = each.join(seen, "t", "left").groupBy("rule", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "t")).getField("t").alias("t"))
    fits = met.join(filed, "t").where(F.regexp(_lower(F.col("u")), F.col("pattern")))
    fits = fits.groupBy(ROW).agg(F.collect_set("rule").alias("patterns"))
    return rows.join(fits, ROW, "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>"))).drop(ROW)


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, patterns) of every row.

    A null address, or one without ``://``, has an empty host and path.  Only the host is
    lower-cased; patterns see the whole address lower-cased.  Without a host rule that fits,
    an address is blocked if a pattern matches and no exception does, and allowed else (also
    a null one).  Rows with equal or null ids stay; other columns are ignored; an empty
    table gives no rows.
    """
    url = F.col(url_col)
    if len(pattern_rules) > LITERAL:
        pages, fits = _joined(pages.select(id_col, url_col), pattern_rules, url), F.col("patterns")
    else:
        fits = _looked_up(pages, pattern_rules, url)

    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    out = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), fits.alias("patterns"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(host_rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        ok = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(ok, F.lit(h + p)).otherwise(rule), F.when(ok, F.lit(v)).otherwise(verdict)
    blocked = F.exists("patterns", lambda r: ~r.startswith("@@")) & ~F.exists("patterns", lambda r: r.startswith("@@"))
    method = F.when(blocked, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.array_join(F.array_sort("patterns"), " ").alias("patterns"))


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    each = ", ".join(f"CASE WHEN regexp_matches(lowered, {quote(to_regex(r))}) THEN {quote(r)} END" for r in sorted(PATTERN_RULES))
    ranked = sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
    ok = lambda h, p: f"(host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)})"
    rule = "CASE " + " ".join(f"WHEN {ok(h, p)} THEN {quote(h + p)}" for h, p, _ in ranked) + " END"
    verdict = "CASE " + " ".join(f"WHEN {ok(h, p)} THEN {quote(v)}" for h, p, v in ranked)
    return f"""
WITH cut AS (SELECT page_id, {low} AS lowered, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, lowered, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
met AS (SELECT *, list_filter([{each}], lambda x: x IS NOT NULL) AS hits FROM parts)
SELECT page_id, host, path, {rule} AS rule,
  {verdict} WHEN len(list_filter(hits, lambda x: NOT starts_with(x, '@@'))) > 0 AND len(list_filter(hits, lambda x: starts_with(x, '@@'))) = 0 THEN 'block' ELSE 'allow' END AS verdict,
  array_to_string(list_sort(hits), ' ') AS patterns
FROM met"""


QUERIES, ORACLES = {"op4_url_rules": op4_url_rules}, {"op4_url_rules": _oracle()}
