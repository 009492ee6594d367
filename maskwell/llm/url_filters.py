"""Exact URL rules by a cascade of Bloom filters. Native operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, lower_ascii

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LEAST_BITS = 1 << 16


class Cascade:
    """Membership of ``listed`` keys, exact for every key of ``universe`` and for the listed keys.

    Level 1 encodes the listed keys, level 2 the other keys of the universe that pass level 1, level 3 the listed keys
    that pass level 2, and so on until a level lets nothing wrong through. A key belongs to the listed ones if the
    first level that refuses it is an even one (or none refuses and their number is odd). Level 1 is sized so that the
    rest holds about as many keys as are listed, therefore all levels together grow with the rules, not the corpus;
    they travel as binary literals, and building stops with an error above ``max_bytes``.

    ``listed`` and ``universe`` have a column ``key``; null keys are ignored.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bytes: int = 64 << 20, max_levels: int = 40):
        self.levels: list[tuple[bytes, int, int]] = []
        listed = kept(listed.where("key is not null").select("key").distinct(), "listed")
        others = kept(universe.where("key is not null").select("key").distinct().join(listed, "key", "left_anti"), "others")
        now, rest = listed, others
        n, m = now.count(), rest.count()
        ratio = max(m, 1) / max(n, 1)
        while n or not self.levels:
            if len(self.levels) == max_levels:
                raise ValueError("the cascade does not end")
            rate = min(0.5, math.sqrt(0.5) / ratio) if not self.levels else 0.5
            bits = max(LEAST_BITS if not self.levels else 64, 1 << math.ceil(math.log2(max(1, 1.44 * n * math.log2(1 / rate)))))
            if bits // 8 + sum(len(x[0]) for x in self.levels) > max_bytes:
                raise ValueError(f"the rules need filters of more than {max_bytes} bytes")
            self.levels.append(self._filter(now, bits, max(1, min(8, round(0.7 * bits / max(n, 1))))))
            passed = kept(rest.where(self._passes(F.col("key"), len(self.levels) - 1)), "passed")
            now, rest = passed, now
            n = now.count()

    def _places(self, key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits).cast("long")) for i in range(hashes)]

    def _filter(self, keys: DataFrame, bits: int, hashes: int) -> tuple[bytes, int, int]:
        level = len(self.levels)
        places = keys.select(F.explode(F.array(*self._places(F.col("key"), level, bits, hashes))).alias("p"))
        found = places.groupBy(F.expr("p div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(p % 8 as int))")).alias("v"))
        out = bytearray(bits // 8)
        for r in found.toLocalIterator():  # at most bits / 8 rows
            out[r["at"]] = r["v"]
        return bytes(out), bits, hashes

    def _passes(self, key: Column, level: int) -> Column:
        data, bits, hashes = self.levels[level]
        out = F.lit(True)
        for p in self._places(key, level, bits, hashes):
            byte = F.conv(F.hex(F.substring(F.lit(data), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.floor(byte / F.pow(F.lit(2), p % 8)) % 2 == 1)
        return out

    def has(self, key: Column) -> Column:
        """Whether ``key`` is listed; null keys are not."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(out)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` for each row of ``pages``.

    ``rules``: ``host``, ``path`` (starting with a slash) and ``verdict`` (block or allow; block where one key has
    both). A rule fits its host and all subdomains if the path starts with the rule's; the longest text of host and
    path wins, at equal length the longer host; without a rule the verdict is allow. Only as many host labels and path
    characters as some rule has are looked up, so very long urls cost no more keys than others. The keys of all pages
    are the universe of the cascades: one for "listed", one that tells blocked from allowed among the listed.

    Null urls have empty host and path. Repeated rows stay repeated; an empty table gives an empty result, an empty
    rule table allows all. Only ``key`` and ``url`` are read.
    """
    listed = kept(rules.select(F.concat("host", "path").alias("key"), "verdict", F.expr("size(split(host, '[.]'))").alias("labels"), F.length("path").alias("chars")), "rules")
    shapes = [tuple(r) for r in listed.select("labels", "chars").distinct().sort("labels", "chars").collect()]  # few forms of rules
    host, path = host_and_path(url)
    split = kept(pages.select(F.col(key).alias("_id"), host.alias("host"), path.alias("path")), "urls")
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1

    def candidate(n: int, chars: int) -> Column:
        fits = (F.col("host") != "") & (labels >= n) & (F.length("path") >= chars)
        return F.when(fits, F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, chars)))

    keys = [candidate(*x) for x in shapes]
    every = F.array(*keys) if keys else F.array().cast("array<string>")
    universe = split.select(F.explode(every).alias("key"))
    known = Cascade(listed, universe)
    blocked = Cascade(listed.where("verdict = 'block'"), listed)
    named = split.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    best = F.lit(None).cast("struct<n:int,h:int,k:string>")
    for i in range(len(shapes)):
        k = F.col(f"_k{i}")
        hit = F.when(known.has(k), F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("h"), k.alias("k")))
        best = hit if i == 0 else F.greatest(best, hit)
    out = named.withColumn("rule", best["k"])
    verdict = F.when(F.col("rule").isNotNull() & blocked.has(F.col("rule")), "block").otherwise("allow")
    return out.select(F.col("_id").alias(key), "host", "path", "rule", verdict.alias("verdict"))
