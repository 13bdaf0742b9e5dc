"""URL filter: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host rules have this rank at least.
HOST_RANK = 1_000_000


@dataclass(frozen=True)
class Rule:
    """name is reported, pattern is searched in `host/path?rest`, of the rules that match the highest rank wins."""

    name: str
    pattern: str
    verdict: str
    literals: tuple[str, ...]
    rank: int


def host_rule(host_path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains, and for the paths that start with its path."""
    host, slash, path = host_path.partition("/")
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    return Rule(host_path, pattern, verdict, _tokens(host_path), HOST_RANK + len(host_path))


def pattern_rule(name: str, pattern: str, verdict: str, literals: Sequence[str]) -> Rule:
    """A rule of a pattern, searched in the lower-cased url; each of literals is a whole token of every url that it matches."""
    return Rule(name, pattern, verdict, tuple(literals), len(pattern))


def _matches(rank: Column, pattern: Column) -> Column:
    """Host rules are true to the case of the path, other patterns are not."""
    return F.call_function("regexp_like", F.when(rank >= HOST_RANK, F.col("key")).otherwise(F.col("low")), pattern)


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z0-9]+", text.lower()))


#: The host rules of the contract, and the method's own patterns for urls that none of them fits.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERN_RULES = (
    ("casino", r"^[^?#]*\bcasino\b", "block", ("casino",)),
    ("poker", r"^[^?#]*\bpoker\b", "block", ("poker",)),
    ("viagra", r"\bviagra\b", "block", ("viagra",)),
    ("porn", r"^[^?#]*\bporn\b", "block", ("porn",)),
    ("session-id", r"[?&]phpsessid=", "block", ("phpsessid",)),
    ("wp-login", r"^[^?#]*/wp-login\.php", "block", ("wp", "login", "php")),
    ("executable", r"^[^?#]*\.exe(?:[?#]|$)", "block", ("exe",)),
    ("archive", r"^[^?#]*\.zip(?:[?#]|$)", "block", ("zip",)),
)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERN_RULES]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rest_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)


def rarest_tokens(rules: Sequence[Rule], counts: dict[str, int] | None = None) -> list[str]:
    """The token that stands for each rule: the rarest by counts, else by the rules themselves; ties to the longer."""
    own = counts if counts is not None else Counter(t for r in rules for t in set(r.literals))
    return [min(r.literals, key=lambda t: (own.get(t, 0), -len(t), t)) for r in rules]


def _buckets(rows: dict[str, list], schema: str) -> Callable[[Column], Column]:
    """The rows filed under a token, as a column: a literal hash table in the plan, an array by crc32 of the token, so a look-up takes
    one bucket however many rows there are. The table's size is that of the rows, which the driver holds as well."""
    size = max(1, 2 * len(rows))
    table: list[list] = [[] for _ in range(size)]
    for token in sorted(rows):
        table[zlib.crc32(token.encode()) % size] += rows[token]
    literal = F.from_json(F.lit(json.dumps(table)), f"array<array<{schema}>>")
    return lambda token: F.get(literal, (F.crc32(token.cast("binary")) % size).cast("int"))


def token_counts(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many urls each literal of the rules stands: as many rows as the rules have literals."""
    filed = _buckets({t: [t] for r in rules for t in r.literals}, "string")
    known = F.filter(_url_tokens(F.col("url")), lambda t: F.array_contains(filed(t), t))
    found = pages.select(F.explode(known).alias("t")).groupBy("t").count()
    return {r["t"]: r["count"] for r in found.collect()}


def read_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules from lines `block host/path`, `allow host/path`, and `block ~ name ~ pattern ~ literal literal`.

    The last form is a pattern, searched in the lower-cased url; its literals are whole tokens (runs of a-z and 0-9) of every
    url that it matches. Empty lines and lines that begin with # are skipped; any other line is an error.
    """
    out = []
    for number, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        verdict, _, rest = line.partition(" ")
        parts = [p.strip() for p in rest.split(" ~ ")] if rest.startswith("~ ") else [rest.strip()]
        if verdict not in ("block", "allow") or not parts[-1]:
            raise ValueError(f"line {number}: not a rule: {line}")
        if rest.startswith("~ "):
            name, pattern, literals = [p.removeprefix("~ ") for p in parts] if len(parts) == 3 else (None, "", "")
            if name is None or not _tokens(literals):
                raise ValueError(f"line {number}: a pattern needs a name and literals: {line}")
            re.compile(pattern)
            out.append(pattern_rule(name, pattern, verdict, _tokens(literals)))
        elif _tokens(rest):
            out.append(host_rule(rest if "/" in rest else rest + "/", verdict))
        else:
            raise ValueError(f"line {number}: a host without letters and digits: {line}")
    return out


def _url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def url_filter(pages: DataFrame, rules: Sequence[Rule] | None = None, default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, matched_by.

    Each rule is filed under its rarest literal token, counted over all urls. The tokens of a url fetch the
    rules filed under them; only those run their regular expression, and the match of highest rank wins: host
    rules by length before the other patterns. The path's case counts for host rules only. `rule` names a host rule only; matched_by names any rule.
    Null urls and urls without `://` have empty host and path, and get the default. Only page_id and url are
    read; repeated rows are judged alike; urls of any length are read whole; an empty table gives no rows. Without
    rules each url gets the default.
    """
    rules = list(default_rules() if rules is None else rules)
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lower(_rest_of(F.col("url"))).alias("rest"))
    parts = parts.withColumn("key", F.concat("host", "path", "rest")).withColumns({"low": F.lower("key"), "tokens": _url_tokens(F.col("url"))})
    index: dict[str, list[dict]] = {}
    for token, rule in zip(rarest_tokens(rules, token_counts(pages, rules)), rules, strict=True):
        index.setdefault(token, []).append({"token": token, "rank": rule.rank, "name": rule.name, "verdict": rule.verdict, "pattern": rule.pattern})
    filed = _buckets(index, "struct<token string, rank int, name string, verdict string, pattern string>")
    fetched = F.flatten(F.transform("tokens", lambda t: F.filter(filed(t), lambda e: e["token"] == t)))
    hits = F.filter("fetched", lambda e: _matches(e["rank"], e["pattern"]))
    best = F.array_max(F.transform(hits, lambda e: F.struct(e["rank"], e["name"], e["verdict"])))
    judged = parts.withColumn("fetched", fetched).withColumn("best", best)
    is_host = F.col("best.rank") >= HOST_RANK
    return judged.select(
        "page_id", "host", "path", F.when(is_host, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.name").alias("matched_by"),
    )
