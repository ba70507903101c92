"""Near-duplicate documents by a signature-coordinate inverted join.

Every document's shingle set has a signature of ``num_hashes`` coordinates, each the minimum of the set under one
hash. A document is posted under each (coordinate, value); two documents at the threshold share ``num_hashes *
threshold`` postings on average, and pairs with fewer than ``min_matches`` are not retained. With the defaults (32, 14)
a link at exactly 0.8 is not retained with probability 1e-6.

* Skips: values posted once are dropped, and with them documents left with fewer than ``min_matches`` values.
* Prefixes: a document with c shared values need only be posted under its c - min_matches + 2 rarest, since two
  documents with min_matches common values have two among those prefixes.
* Merging: each posting list pairs its members with one member, that with the fewest values of its own, so lists
  yield as many pairs as members. Retained pairs are confirmed on the full sets. Of what is left between different components,
  lists of up to ``short_list`` members are joined member by member; the members of longer lists (crowds around one
  text) meet through the rarest fifth of their shingles, which is exact and does not pair a crowd with itself.

Identical sets are one node from the start, whatever their number. Counts that are joined back to lists are written first,
so that both sides of such a join are plain shuffles, which adaptive execution splits where one key has very many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from quillframe.llm.common import MIX_A, MIX_B, MIX_C, column_bytes, materialise, mix64
from quillframe.llm.components import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * MIX_A)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 18


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each document: the sorted 64-bit hashes of its distinct shingles (one for a text with fewer words)."""
    n = len(offs) - 1
    at = 0
    while at < n:
        end = at + 1
        while end < n and offs[end + 1] - offs[at] <= _BLOCK:
            end += 1
        yield from _block_sets(data, offs[at : end + 1], words)
        at = end


def _block_sets(data: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    base, size = int(offs[0]), int(offs[-1] - offs[0])
    raw = data[base : base + size]
    gap = _SPACE[raw]
    cut = (offs[1:-1] - base).astype(np.int64)
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    edge = cut[cut < size]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= gap[1:]
    edge = cut[(cut > 0)] - 1
    last[edge] = inside[edge]
    stop = np.flatnonzero(last) + 1
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * _powers(size, _BASE), out=total[1:])
    word = (total[stop] - total[start]) * _powers(size + 1, _BASE_INV)[start]
    word = mix64(word ^ ((stop - start).astype(np.uint64) * MIX_C))
    lo = np.searchsorted(start, offs[:-1] - base)
    hi = np.searchsorted(start, offs[1:] - base)
    joined = np.zeros(max(len(word) - words + 1, 0), np.uint64)
    for j in range(words):
        joined = mix64(joined * MIX_A + word[j : j + len(joined)])
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b - a >= words:
            yield np.unique(joined[a : b - words + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in word[a:b]:
                h = mix64(h * MIX_B + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)


def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, n + 1, dtype=np.uint64)
    return mix64(seed * MIX_A) | np.uint64(1), mix64(seed * MIX_B)


def _sign(words: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coordinates(hashes)
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            count, hi, lo, sig = [], [], [], []
            for s in shingle_sets(data, offs, words):
                count.append(len(s))
                if len(s):
                    low = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
                    for i in range(0, len(s), 1024):
                        low = np.minimum(low, (s[i : i + 1024, None] * a + b).min(0))
                    sig.append(mix64(low ^ a).view(np.int64))
                else:
                    sig.append(np.zeros(0, np.int64))
                hi.append(mix64(s * MIX_C).sum(dtype=np.uint64))
                lo.append(mix64(s ^ MIX_B).sum(dtype=np.uint64))
            flat = np.concatenate(sig) if sig else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sig]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(np.array(hi, np.uint64).view(np.int64)), pa.array(np.array(lo, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "n", "hi", "lo", "sig"],
            )

    return run


_SIGNED = "id long, n long, hi long, lo long, sig array<long>"


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            data, offs = column_bytes(batch.column(3))
            a, b, salt = (batch.column(i).to_pylist() for i in range(3))
            u, v = [], []
            for x, y, z, s in zip(a, b, salt, shingle_sets(data, offs, words), strict=True):
                if y is None:  # the hub comes first in its group
                    group, hub = (x, z), s
                    continue
                if group != (x, z):
                    raise ValueError("a pair without its hub")
                small, large = (s, hub) if len(s) < len(hub) else (hub, s)
                if not len(small) or 100 * len(small) < percent * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(small) + len(large) - both):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int, per_group: int = 512) -> DataFrame:
    """The pairs ``(u, v)`` whose full shingle sets meet the threshold; a hub's partners are dealt over several groups."""
    sizes = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("cnt"))
    groups = sizes.select("u", F.ceil(F.col("cnt") / per_group).cast("int").alias("g"))
    members = pairs.join(groups, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("g")).cast("int").alias("salt"))
    members = members.join(texts.withColumnRenamed("id", "v"), "v").select("u", "v", "salt", "text")
    used = members.select("u", "salt").distinct()
    hubs = used.join(texts.withColumnRenamed("id", "u"), "u").select("u", F.lit(None).cast("long").alias("v"), "salt", "text")
    dealt = members.union(hubs).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return dealt.mapInArrow(_confirm(words, percent), "u long, v long")


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column_bytes(batch.column(2))
            found = list(shingle_sets(data, offs, words))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "comp", "set"])

    return run


def _with_root(df: DataFrame, roots: DataFrame, name: str, as_: str) -> DataFrame:
    return df.join(roots.select(F.col("node").alias(name), F.col("root").alias("__qf_r")), name, "left").withColumn(as_, F.coalesce("__qf_r", name)).drop("__qf_r")


def _shingle_pairs(members: DataFrame, roots: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """For crowds around one text, whose members share most coordinates without being near enough: new components,
    and the pairs of ``members(id)`` that can meet the threshold and still are in different ones.

    Two sets at the threshold share a shingle among the rarest fifth of each, with enough shingles after it in both,
    so documents with many shingles of their own fall out. Each shingle's list is first linked to its member with the
    fewest such shingles, so that hardly any pairs are left to join.
    """
    sets = materialise(members.join(texts, "id").select("id", F.lit(0).cast("long").alias("comp"), "text").mapInArrow(_sets(words), "id long, comp long, set array<long>"), "crowd")
    tokens = sets.select("id", F.explode("set").alias("token"))
    freq = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), "crowd-counts")
    ranked = tokens.join(freq, "token", "left").withColumn("freq", F.coalesce("freq", F.lit(1).cast("long"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("held"))
    size = F.size("held")
    least = F.ceil(size * percent / 100).cast("int")
    own = F.size(F.filter("held", lambda x: x["freq"] == 1)) / size
    heads = ranked.select("id", size.alias("n"), own.alias("own"), F.posexplode(F.slice("held", 1, size - least + 1)).alias("pos", "x"))
    heads = materialise(heads.where("x.freq > 1").select("id", "n", "own", "pos", F.col("x.token").alias("token")), "crowd-prefixes")
    overlap = f"n - pos >= {percent} * (n + n2) / {100 + percent} - 1e-6 and n2 - pos2 >= {percent} * (n + n2) / {100 + percent} - 1e-6"
    hub = heads.groupBy("token").agg(F.min(F.struct("own", F.xxhash64("id"), "id", "n", "pos")).alias("h"), F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    hub = materialise(hub.select("token", F.col("h.id").alias("id2"), F.col("h.n").alias("n2"), F.col("h.pos").alias("pos2")), "crowd-heads")
    to_hub = heads.join(hub, "token").where("id <> id2").where(overlap).groupBy(F.col("id2").alias("u"), F.col("id").alias("v")).agg(F.count(F.lit(1)).alias("met"))
    to_hub = _with_root(_with_root(to_hub, roots, "u", "ru"), roots, "v", "rv").where("ru <> rv")
    best = to_hub.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("met"), "u"))).where("rank <= 3").select("u", "v")
    links = confirm(materialise(best, "crowd-hubs"), texts, words, percent)
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links))
    tagged = materialise(_with_root(heads.drop("own"), roots, "id", "comp"), "crowd-lists")
    per = tagged.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("cnt"))
    major = per.groupBy("token").agg(F.max(F.struct("cnt", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    major = materialise(major.select("token", F.col("m.comp").alias("major")), "crowd-majors")
    lists = materialise(tagged.join(major, "token"), "crowd-mixed")
    left = lists.where("comp <> major").drop("major")
    right = lists.select("token", "major", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "pos", "comp")])
    pairs = left.join(right, "token").where(f"comp <> comp2 and (comp2 = major or id < id2) and {overlap}")
    return roots, pairs.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct()


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, num_hashes: int = 32, min_matches: int = 14, short_list: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Links join texts whose sets of distinct ``words``-word shingles have a Jaccard similarity of ``percent``/100 or
    more; ``component_id`` is the smallest id reachable over links. Defined cases: a null text or one without words
    has an empty set and links with nothing; a text with fewer words than a shingle is one shingle; rows that share
    an id count as one node (its links are judged on the largest of its texts); rows with a null id keep their row and take part only through identical sets (their
    component is the set's smallest id, null if it has none); an empty table gives no rows.
    """
    raw = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = materialise(raw.mapInArrow(_sign(words, num_hashes), _SIGNED), "signatures")
    classes = signed.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = materialise(classes, "classes")
    postings = nodes.where("rep is not null").select("rep", F.explode("sig").alias("key"))
    shared = materialise(postings.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), "shared")
    sized = nodes.select("rep", "n")
    found = postings.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("freq", "key"))).alias("held")).where(F.size("held") >= min_matches)
    held = materialise(
        found.join(sized.groupBy("rep").agg(F.max("n").alias("n"), F.min("n").alias("low")), "rep").select(
            "rep", "n", "low",
            F.transform("held", lambda x: F.hash(x["key"])).alias("keys"),
            F.transform(F.slice("held", 1, F.size("held") - (min_matches - 2)), lambda x: x["key"]).alias("prefix"),
        ),
        "prefixes",
    )
    lists = held.select("rep", "n", "low", F.size("keys").alias("c"), F.explode("prefix").alias("key"))
    rank = F.struct((-F.col("c")).alias("c"), F.xxhash64("rep").alias("r"), F.col("rep"), F.col("n"), F.col("low"))
    per_key = materialise(lists.groupBy("key").agg(F.min(rank).alias("hub"), F.count(F.lit(1)).alias("cnt")).where("cnt > 1"), "hubs")
    lists = materialise(lists.join(per_key, "key").select("key", "rep", "n", "low", "cnt", "hub"), "lists")
    fits = lambda a_low, a_n, b_low, b_n: (100 * a_n >= percent * b_low) & (100 * b_n >= percent * a_low)
    keys = held.select("rep", "keys")

    def retained(p: DataFrame) -> DataFrame:
        """Pairs that meet in two lists or more and have enough collisions over all coordinates."""
        twice = p.groupBy("u", "v").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
        both = twice.join(keys.select(F.col("rep").alias("v"), F.col("keys").alias("kv")), "v").join(keys.select(F.col("rep").alias("u"), F.col("keys").alias("ku")), "u")
        return both.withColumn("same", F.size(F.array_intersect("ku", "kv"))).where(F.col("same") >= min_matches).select("u", "v", "same")

    to_hub = lists.where(F.col("rep") != F.col("hub.rep")).where(fits(F.col("low"), F.col("n"), F.col("hub.low"), F.col("hub.n")))
    order = Window.partitionBy("v").orderBy(F.desc("same"), "u")
    first = retained(to_hub.select(F.col("hub.rep").alias("u"), F.col("rep").alias("v")))
    first = materialise(first.withColumn("rank", F.row_number().over(order)).where("rank <= 2").select("u", "v"), "hub-pairs")
    short = lists.where(F.col("cnt") <= short_list).select("key", "rep", "n", "low")
    other = short.select("key", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "low")])
    met = short.join(other, "key").where(F.col("rep") < F.col("rep2")).where(fits(F.col("low"), F.col("n"), F.col("low2"), F.col("n2")))
    near = materialise(retained(met.select(F.col("rep").alias("u"), F.col("rep2").alias("v"))).select("u", "v"), "list-pairs")
    crowded = lists.where(F.col("cnt") > short_list).select("key", F.col("rep").alias("id"))
    wanted = crowded.select("id")
    for p in (first, near):
        wanted = wanted.union(p.select(F.explode(F.array("u", "v"))))
    texts = materialise(raw.join(wanted.distinct(), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")), "texts")
    links = materialise(confirm(first, texts, words, percent), "links")
    roots = components(links)
    tagged = _with_root(crowded, roots, "id", "comp")
    mixed = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    crowd = tagged.join(mixed, "key").select("id").distinct()
    roots, rest = _shingle_pairs(crowd, roots, texts, words, percent)
    near = _with_root(_with_root(near, roots, "u", "ru"), roots, "v", "rv").where("ru <> rv").select("u", "v")
    more = confirm(materialise(near.union(rest).distinct(), "cross-pairs"), texts, words, percent)
    final = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), "components")
    named = signed.where("n > 0").join(nodes.select("hi", "lo", "rep"), ["hi", "lo"]).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("id", "n", F.coalesce("root", "rep").alias("component_id"))
    bare = signed.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return named.union(bare).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate component, with all their columns.

    Defined cases are those of ``near_duplicates``: rows without words stay, rows that share a kept id all stay, a row
    with a null id stays only if its text has no words or equals no row's with an id; an empty table stays empty.
    """
    kept = near_duplicates(docs, id_col=id_col, **options).where("kept").select(F.col(id_col).alias("__qf_id")).distinct()
    return docs.join(kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__qf_id")), "left_semi")


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=2)


OP5_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') as w from documents),
shingles as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as y from documents union select reach.x, both_ways.y from reach join both_ways on reach.y = both_ways.x),
roots as (select x, min(y) as component_id from reach group by x)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from documents left join sizes using (doc_id) join roots on x = doc_id
"""
