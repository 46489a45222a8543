"""URL rules held in a cascade of Bloom filters.

Level 1 holds the listed keys.  Of all keys that occur in the corpus, those that
pass it without being listed go into level 2, listed keys that pass level 2 into
level 3, and so on until a level lets nothing of the other kind through.  For
every key of the corpus the cascade then answers exactly, as one expression
inside the scan, with no join.  Level 1 is sized for about as many false
positives as there are listed keys, so the filters grow with the list, not with
the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import kept, lower_ascii
from obsweave.operators.ranking import free_name

MAX_BITS = 1 << 26  # 8 MB a level; a longer list raises


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path by the rule of ``judge``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every key that could fit: host suffix at a label, path prefix of a listed length.

    Longest key first; of equal lengths, the one with the longer host first.
    """
    if not lengths:  # no rules
        return F.array().cast("array<string>")
    labels = F.split(host, r"\.", -1)
    count = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count - i + 1), ".")
    )
    def pairs(tail: int) -> Column:
        keys = F.transform(
            suffixes,
            lambda s: F.struct(
                (-(F.char_length(s) + tail)).alias("order"),
                F.lit(tail).alias("tail"),
                F.concat(s, F.substring(path, 1, tail)).alias("key"),
            ),
        )
        none = F.array().cast("array<struct<order:int,tail:int,key:string>>")
        return F.when(F.char_length(path) >= tail, keys).otherwise(none)

    found = F.transform(F.sort_array(F.flatten(F.array(*[pairs(n) for n in lengths]))), lambda p: p["key"])
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


@dataclass(frozen=True)
class Bloom:
    seed: int
    bits: int
    hashes: int
    words: np.ndarray

    def holds(self, key: Column) -> Column:
        words = F.lit(self.words)

        def bit(i: int) -> Column:
            at = F.pmod(F.xxhash64(F.lit(self.seed * 64 + i), key), F.lit(self.bits).cast("bigint"))
            word = F.get(words, F.floor(at / 64).cast("int"))
            return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

        held = bit(0)
        for i in range(1, self.hashes):
            held = held & bit(i)
        return held


def bloom(keys: DataFrame, count: int, rate: float, seed: int) -> Bloom:
    """A filter over the ``key`` column with about ``rate`` false positives."""
    bits = max(64, 64 * math.ceil(count * math.log(1 / rate) / math.log(2) ** 2 / 64))
    if bits > MAX_BITS:
        raise ValueError(f"{count} keys at {rate} need {bits} bits, the limit is {MAX_BITS}")
    hashes = max(1, round(bits / max(count, 1) * math.log(2)))
    hashes = min(hashes, max(1, math.ceil(math.log2(1 / rate))))
    places = F.array(
        *[F.pmod(F.xxhash64(F.lit(seed * 64 + i), "key"), F.lit(bits).cast("bigint")) for i in range(hashes)]
    )
    filled = (
        keys.select(F.explode(places).alias("at"))
        .groupBy(F.floor(F.col("at") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
    )
    words = np.zeros(bits // 64, np.int64)
    for row in filled.collect():  # at most bits / 64 rows
        words[row["word"]] = row["set"]
    return Bloom(seed, bits, hashes, words)


def cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> list[Bloom]:
    """Levels that tell ``listed`` keys from all other keys of ``universe``."""
    here = listed.select("key").distinct()
    n_here = here.count()
    if not n_here:
        return []
    n_all = universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [bloom(here, n_here, min(0.5, n_here / max(n_all, 1)), seed)]
    there = universe.filter(levels[0].holds(F.col("key"))).distinct().join(here, "key", "left_anti")
    there = kept(there, "false-positives")
    while n_there := there.count():
        levels.append(bloom(there, n_there, 0.5, seed + len(levels)))
        here, there = there, kept(here.filter(levels[-1].holds(F.col("key"))), "cascade")
    return levels


def listed_in(levels: Sequence[Bloom], key: Column) -> Column:
    """Exact for every key of the universe the levels were made over."""
    found = F.lit(False)
    for level in reversed(levels):
        found = level.holds(key) & ~found
    return found


def judge(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """The rows of ``pages`` with ``host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict`` (allow or block).  Host: after the
    first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    then up to ``?``, ``#`` or the end.  A null url or one without ``://`` has
    both empty and fits no rule.  A rule fits its host and all subdomains, if
    the path starts with its path; the longest host-and-path wins.  A url on no
    list is not a member of the blocked keys, hence ``default``.  Columns of
    these names that the input has already are replaced.  Repeated rows are
    judged one by one; empty tables give empty tables.
    """
    spark = pages.sparkSession
    rules = rules.select(
        F.concat("host", "path").alias("key"), F.char_length("path").alias("tail"), "verdict"
    )
    lengths = [r["tail"] for r in rules.select("tail").distinct().orderBy("tail").collect()]
    host, path = host_and_path(F.col(url_col))
    sites = pages.select(host.alias("host"), path.alias("path")).filter("host <> ''")
    universe = kept(
        sites.select(F.explode(candidates(F.col("host"), F.col("path"), lengths)).alias("key")).distinct(),
        "url-keys",
    )
    listed = {v: rules.filter(F.col("verdict") == v).select("key") for v in ("allow", "block")}
    everything = universe.union(rules.select("key")).distinct()
    levels = {v: cascade(keys, everything, seed) for (v, keys), seed in zip(listed.items(), (100, 200))}

    def verdict(key: Column) -> Column:
        # A key on both lists is blocked.
        return F.when(listed_in(levels["block"], key), "block").when(
            listed_in(levels["allow"], key), "allow"
        )

    judged = F.transform(
        candidates(F.col("host"), F.col("path"), lengths),
        lambda key: F.struct(key.alias("rule"), verdict(key).alias("verdict")),
    )
    first = F.get(F.filter(judged, lambda j: j["verdict"].isNotNull()), F.lit(0))
    of_page = pages.drop("rule", "verdict").withColumns({"host": host, "path": path})
    hit = free_name(of_page, "_hit")
    return (
        of_page.withColumn(hit, first)
        .withColumns({"rule": F.col(f"{hit}.rule"), "verdict": F.coalesce(f"{hit}.verdict", F.lit(default))})
        .drop(hit)
    )
