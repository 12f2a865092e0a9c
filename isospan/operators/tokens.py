"""Names by their tokens, where no spelling is known.

An inverted index leads from a token to the countries some spelling of which has
it. A name's tokens leave those countries that have all of them; of these it
must spell one in full but for words of form, and more of it than any other.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..refdata import dictionary
from ..refdata.crosswalk import normal
from ..refdata.historical import ALIASES as HISTORICAL

#: Words that tell no country from another by themselves.
FORM = set("republic kingdom state states island islands democratic federated federal federation peoples people arab islamic united socialist bolivarian plurinational province territory territories city union special administrative region sar commonwealth principality sultanate emirate duchy grand hashemite cooperative independent jamahiriya confederation".split())
LITTLE = {"of", "the", "and", ""}
ENDINGS = ("n", "an", "ian", "ese", "i")
LEAST_PREFIX = 3

#: Lookups are by crc32, so that a token meets a handful of others only.
BUCKETS = 256
SCHEMA = "_vocab array<map<string, array<int>>>, _prefixes array<map<string, array<string>>>, _every array<array<string>>, _cores array<array<array<string>>>, _own array<array<string>>, _codes array<string>, _past array<string>"


def token_index(spark: SparkSession) -> DataFrame:
    """One row: which countries have a token, whole tokens of an abbreviation,
    each country's spellings without words of form, all its tokens, its code;
    and tokens that only dissolved countries have."""
    known = dictionary(spark)
    codes = sorted(set(known.values()))
    number = {c: i for i, c in enumerate(codes)}
    own: list[set] = [set() for _ in codes]
    cores: list[set] = [set() for _ in codes]
    vocab: dict[str, set] = {}
    singles: dict[str, int] = {}
    for key, code in known.items():
        tokens = [t for t in key.split(" ") if t not in LITTLE]
        core = [t for t in tokens if t not in FORM] or tokens
        if not core or all(len(t) < 4 for t in core):  # abbreviations count only as they are
            core = []
        own[number[code]] |= set(tokens)
        if core:
            cores[number[code]].add(tuple(core))
        for t in core:
            vocab.setdefault(t, set()).add(number[code])
        if len(core) == 1:
            singles[core[0]] = number[code]
    for name, i in singles.items():
        for people in [name + e for e in ENDINGS] + [name[:-1] + e for e in ("ian", "an", "ese", "i")]:
            if people not in vocab:
                vocab[people] = {i}
                own[i].add(people)
                cores[i].add((people,))
    prefixes: dict[str, set] = {}
    for t in [t for t in vocab if not any(t == n + e for n in singles for e in ENDINGS)]:
        for k in range(LEAST_PREFIX, len(t)):
            if t[:k] not in vocab:
                prefixes.setdefault(t[:k], set()).add(t)
    every = {t for s in own for t in s}
    past = sorted({t for a in HISTORICAL for t in normal(a).split(" ")} - every - LITTLE - FORM)

    def bucketed(items: dict) -> list[dict]:
        out: list[dict] = [{} for _ in range(BUCKETS)]
        for k, v in items.items():
            out[zlib.crc32(k.encode()) % BUCKETS][k] = sorted(v)
        return out

    row = (bucketed(vocab), bucketed(prefixes), [list(b) for b in bucketed(dict.fromkeys(every, ()))], [[list(c) for c in sorted(s)] for s in cores], [sorted(s) for s in own], codes, past)
    return spark.createDataFrame([row], SCHEMA)


def code_by_tokens(raw: Column, key: Column) -> Column:
    """The code of a normalised name; needs the index's columns beside it.

    Tokens that no country has are passed over if they are no more than those
    that count, except those of dissolved countries. With full stops in the raw
    name, beginnings of tokens stand for them. Null where two countries fit alike.
    """
    bucket = lambda x: (F.crc32(x) % BUCKETS).cast("int")
    found = lambda table, x: F.try_element_at(F.get(table, bucket(x)), x)
    tokens = F.array_distinct(F.filter(F.split(key, " "), lambda t: ~t.isin(*LITTLE)))

    def fitted(t):
        whole = lambda x: found("_vocab", x)
        longer = lambda x: F.when(raw.contains("."), found("_prefixes", x))
        sets = F.array_compact(F.transform(t, lambda x: F.coalesce(whole(x), F.array_distinct(F.flatten(F.transform(longer(x), whole))))))
        spelled = F.array_distinct(F.concat(t, F.flatten(F.array_compact(F.transform(t, lambda x: F.when(whole(x).isNull(), longer(x)))))))
        return F.struct(t.alias("t"), spelled.alias("spelled"), sets.alias("sets"))

    def best(s):
        left = F.aggregate(F.slice(s["sets"], 2, F.greatest(F.size(s["sets"]), F.lit(1))), F.get(s["sets"], 0), lambda a, b: F.array_intersect(a, b))
        full = F.filter(left, lambda c: F.exists(F.get("_cores", c), lambda core: F.size(F.array_except(core, s["spelled"])) == 0))
        scored = F.transform(full, lambda c: F.struct(F.size(F.array_intersect(F.get("_own", c), s["spelled"])).alias("n"), c.alias("c")))
        return F.struct(scored.alias("scored"), F.arrays_overlap(s["t"], "_past").alias("past"), s["spelled"].alias("spelled"))

    def decided(b):
        top = F.array_max(b["scored"])
        alike = F.size(F.filter(b["scored"], lambda x: x["n"] == top["n"]))
        strange = F.size(F.filter(b["spelled"], lambda x: ~F.array_contains(F.get("_every", bucket(x)), x) & found("_prefixes", x).isNull()))
        return F.when((alike == 1) & ~b["past"] & (strange <= top["n"]), F.get("_codes", top["c"]))

    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return bound(bound(bound(tokens, fitted), best), decided)
