"""URL filters with a cascade of Bloom filters, in DataFrame functions only.

Level 1 holds the listed keys; level 2 holds those keys of the corpus that level 1 lets through wrongly; level 3 the listed
keys that level 2 takes for those; and so on, until no key is mistaken. Over the complete universe of the corpus's keys the
answer is exact, and a lookup touches a few bits: no join, no key list in the tasks.

A filter's size is known before it is built (from the counts of keys). Up to ``MAX_BITS`` in all a cascade travels as a constant in
the plan. Beyond, keys and rows are parted by a hash of the key, and each part has a cascade of its own under that bound: parts
are written as folders once, so each reads only its own rows, and the driver holds the bits of one part at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootloom.llm.shared import kept, new_folder

#: 1 MB as longs; a level's words are collected to the driver under this bound.
MAX_BITS = 1 << 23
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules judged first, and the words that put a host on the list.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]
    number: int

    def positions(self, key: Column) -> list[Column]:
        return _positions(key, self.number, self.bits, self.hashes)

    def accepts(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a constant, once a level
        return F.forall(F.array(*self.positions(key)), lambda p: F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; a null key isn't."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.accepts(key), out).otherwise(F.lit(level.number % 2 == 0))
        return key.isNotNull() & out


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    one = F.pmod(F.xxhash64(F.lit(number), key), F.lit(bits))
    two = F.pmod(F.xxhash64(key, F.lit(number)), F.lit(bits)).bitwiseOR(F.lit(1))
    return [F.pmod(one + two * F.lit(k), F.lit(bits)) for k in range(hashes)]


def _shape(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return bits, max(1, min(30, round(bits / max(n, 1) * math.log(2))))


def _level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    bits, hashes = _shape(n, rate)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("p"))
    cells = at.groupBy((F.col("p") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    words = [0] * (bits // 64)
    for r in cells.collect():  # bits / 64 rows at most
        words[r["word"]] = r["v"]
    return Level(bits, hashes, tuple(words), number)


def marked_keys(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """(key, listed): the different non-null keys of both, written down; listed keys outside the universe count as part of it."""
    both = universe.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True)))
    return kept(both.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "keys")


def _first_rate(n_in: int, n_out: int) -> float:
    return min(0.5, max(1e-6, 0.7 * n_in / max(n_out, 1)))


def expected_bits(n_in: int, n_out: int) -> int:
    """Bits of all levels, as they come out on average."""
    rate, bits = _first_rate(n_in, n_out), 0
    while n_in >= 1:
        bits += _shape(int(n_in), rate)[0]
        n_in, n_out, rate = n_out * rate, n_in, 0.5
    return bits


def cascade_of(marked: DataFrame) -> Cascade:
    """The cascade over keys (key, listed), each once; every level reads that table."""
    inside, outside = marked.where("listed").select("key"), marked.where("not listed").select("key")
    n_in, n_out = (marked.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()) or (0, 0)
    rate = _first_rate(n_in, n_out)
    levels: list[Level] = []
    while n_in:
        level = _level(inside, n_in, rate, len(levels) + 1)
        levels.append(level)
        # What the new level mistakes are the keys of the next one.
        inside, outside, rate = outside.where(level.accepts(F.col("key"))), inside, 0.5
        n_in = inside.count()
    return Cascade(tuple(levels))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Over non-null keys (column ``key``); a repeated key counts once. For sides of a known size: all bits travel in the plan."""
    return cascade_of(marked_keys(listed, universe))


def mark_listed(rows: DataFrame, key: str, listed: DataFrame, universe: DataFrame, flag: str = "listed", max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with a boolean: whether ``key`` (text) is listed, by one cascade, or by one for each part of the keys beyond ``max_bits``.

    A null key isn't listed; repeated rows each keep their own; keys that are repeated in ``listed`` or ``universe`` count once; every
    key of ``rows`` has to be in ``universe`` (or listed) for the answer to be exact. No keys at all: nothing is listed.
    """
    marked = marked_keys(listed, universe)
    n_in, n_out = (marked.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()) or (0, 0)
    parts = -(-2 * expected_bits(n_in, n_out) // max_bits)  # half full on average, as parts aren't quite equal
    if parts <= 2:
        return rows.withColumn(flag, cascade_of(marked).contains(F.col(key)))
    spark, part = rows.sparkSession, f"{flag}_part"
    folders = []
    for df, column in ((marked, "key"), (rows, key)):
        folders.append(new_folder(spark, "parts"))
        # A hot key's rows may fill several files of their part.
        df.withColumn(part, F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")).hint("rebalance", part).write.partitionBy(part).parquet(folders[-1])
    keys, parted = (spark.read.schema(T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())])).parquet(at) for df, at in zip((marked, rows), folders, strict=True))
    found = None
    for k in range(parts):
        cascade = cascade_of(keys.where(F.col(part) == k).select("key", "listed"))
        mine = kept(parted.where(F.col(part) == k).drop(part).withColumn(flag, cascade.contains(F.col(key))), "listed")
        found = mine if found is None else found.union(mine)
    return found


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_candidates(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """All keys that a rule matching this url could have: the host's last labels with the path's first characters."""
    parts = [_split_rule(r) for r, _ in rules]
    labels = F.split(host, r"\.")
    depth = max((h.count(".") + 1 for h, _ in parts), default=1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, p in parts}) or [0]])
    return F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


def listed_hosts(hosts: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """An example of a block list, taken where none is given: hosts with one of the words as a label or a part of a label between hyphens."""
    return hosts.where(F.col("key").rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row.

    A rule (host/path) fits its host and subdomains if the url's path begins with the rule's; the longest fitting rule (of
    equals, the one first in the alphabet) gives the verdict. Without one, a host on the block list is blocked and any other
    allowed. ``listed``: a table with the column ``key`` of hosts (default: ``listed_hosts``). Both lookups go through a
    cascade over all the keys that the table has.

    A null url, or one without ``://``, has an empty host and path; a rule's path begins with its slash, so ``com/`` doesn't fit
    a url that ends with its host. A url of any length is judged whole; null ids stay; repeated rows each give a row; an empty
    table gives no rows; other columns aren't read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("candidates", rule_candidates(F.col("host"), F.col("path"), rules))
    hosts = kept(rows.select(F.col("host").alias("key")).distinct(), "hosts")
    listed = listed_hosts(hosts) if listed is None else listed.select("key").where("key is not null").distinct()
    rule_keys = _literal_keys(spark, [r for r, _ in rules])
    by_rule = build_cascade(rule_keys, rows.select(F.explode("candidates").alias("key")).distinct())
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.create_map().cast("map<string,string>")
    fits = F.filter("candidates", by_rule.contains)
    best = F.array_min(F.transform(fits, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))["key"]
    rows = mark_listed(rows.withColumn("rule", best).drop("candidates"), "host", listed, hosts)
    verdict = F.coalesce(F.try_element_at(verdicts, F.col("rule")), F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "listed")


def _literal_keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys]).cast("array<string>")).alias("key")).distinct()


ORACLE = f"""
with urls as (
  select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(rule, rule_host, rule_path, said) as (values
  {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)}),
best as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(said, length(rule)) as said
  from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id)
select u.page_id, u.host, u.path, b.rule,
       coalesce(b.said, case when regexp_matches(u.host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') then 'block' else 'allow' end) as verdict,
       regexp_matches(u.host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') as listed
from urls u left join best b using (page_id)
"""
