"""Near-duplicates by SimHash fingerprints, found by the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits are linked. The 64 bits are grouped into parts so that correlated
bits share a part; each part gets a threshold of its own, with all thresholds summing to ``radius`` - parts + 1, so that
two linked fingerprints are within the threshold of one part at least. A threshold of -1 leaves a part out. Thresholds
are chosen by dynamic programming over candidate counts estimated from the parts' value histograms. Fingerprints that
share a probed part value are compared bit by bit.

With a similarity, texts are linked by the Jaccard similarity of their shingles instead. At 0.8 two fingerprints differ
in about 10 bits of 64 and often in 18, which no part of a few bits can probe; so candidates there come from equal bands
of minima of shingle hashes, and every link is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spool, spool
from .components import connected_components

BITS = 64
RADIUS = 4
SHINGLE = 4
#: Of a bucket of more fingerprints than this, links are found by meeting half way instead of pair by pair.
LARGE_BUCKET = 16_384
#: The cost of a probe that is written and sorted, in comparisons.
PROBE_COST = 400
#: Bands of minima for similarities, and minima to a band: at 0.8 two texts share no band in 5 of 100 million cases.
BANDS, BAND_ROWS = 32, 4
_DRAWS = np.random.default_rng(64).integers(0, 1 << 63, (2, BANDS * BAND_ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """One hash for each run of ``width`` words (for all words of a shorter text); none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    ends = np.concatenate((ends[width - 1 :], [len(joined)])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a whole text; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: list[int]) -> int:
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of the band's number and its minima over the distinct shingles."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[lo : lo + 512, None] ^ _DRAWS[0]) * _DRAWS[1]).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """(id, f): f is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "f"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, f bigint")


def with_shingle_sets(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, f, s, bands, t): the fingerprint, a hash of the set of shingles, the set's band keys, a hash of the text."""
    schema = "id bigint, f bigint, s bigint, bands array<bigint>, t bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                f, s, bands = [], [], []
                for x in part.column(1):
                    hashes = shingle_hashes(x.as_py(), width)
                    distinct = np.unique(np.array(hashes, np.uint64))
                    f.append(fingerprint_of(hashes))
                    s.append(xxhash.xxh64_intdigest(distinct.tobytes()))
                    bands.append(band_keys(distinct) if len(distinct) else [])
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f, s)]
                yield pa.RecordBatch.from_arrays([part.column(0), *signed, pa.array(bands, pa.list_(pa.int64())), part.column(2)], ["id", "f", "s", "bands", "t"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")).mapInArrow(run, schema)


def similar_in(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with Jaccard ``similarity`` at least, among non-empty sets; no pair is left out.

    Two such sets share one of the rarest shingles of each: only these are indexed. Sets that are connected already are
    not compared again.
    """
    sizes = np.array([len(x) for x in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    order = np.lexsort((rank[token], owners))
    ranked = np.split(rank[token][order], np.cumsum(sizes)[:-1])
    prefixes = [r[: n - int(np.ceil(similarity * n - 1e-9)) + 1] for r, n in zip(ranked, sizes)]
    prefix_owner = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
    flat = np.concatenate(prefixes)
    by_token = np.argsort(flat, kind="stable")
    flat, prefix_owner = flat[by_token], prefix_owner[by_token]
    label, links = np.arange(len(sets)), []
    for i, prefix in enumerate(prefixes):
        spans = zip(np.searchsorted(flat, prefix), np.searchsorted(flat, prefix, side="right"))
        near = np.unique(np.concatenate([prefix_owner[a:b] for a, b in spans]))
        near = near[(near > i) & (label[near] != label[i])]
        near = near[(sizes[near] >= similarity * sizes[i] - 1e-9) & (sizes[i] >= similarity * sizes[near] - 1e-9)]
        for j in near:
            if label[j] != label[i]:
                shared = len(np.intersect1d(ranked[i], ranked[j], assume_unique=True))
                if shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9:
                    links.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return links


def similar_links(rows: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b): links between distinct shingle sets (column ``s``), enough to connect all whose similarity is reached.

    Sets that share a band are gathered into groups by their keys alone, without regard to similarity; groups, which no
    link leaves, then get one of ``texts`` for each set and compare them whole. A group's texts must fit a task's memory.
    """
    bands = spool(rows.where("size(bands) > 0").select("s", F.explode("bands").alias("band")).distinct())
    hosts = bands.groupBy("band").agg(F.min("s").alias("host"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "host")
    together = bands.join(hosts, "band").where("s <> host").select(F.col("s").alias("a"), F.col("host").alias("b")).distinct()
    groups = connected_components(together).select(F.col("node").alias("gs"), F.col("component").alias("g"))
    one = rows.groupBy("s").agg(F.min("t").alias("t"))  # texts of one set are alike
    wanted = spool(groups.join(one, F.col("gs") == F.col("s")).select("s", "g", F.col("t").alias("at")))
    drop_spool(bands)

    def compare(t: pa.Table) -> pa.Table:
        keys = t.column("s").to_pylist()
        links = similar_in([np.unique(np.array(shingle_hashes(x.as_py(), width), np.uint64)) for x in t.column("text")], similarity)
        return pa.table({"a": pa.array([keys[i] for i, _ in links], pa.int64()), "b": pa.array([keys[j] for _, j in links], pa.int64())})

    found = texts.withColumn("t", F.xxhash64("text")).join(wanted, F.col("t") == F.col("at")).select("s", "g", "text").dropDuplicates(["s"])
    return found.groupBy("g").applyInArrow(compare, "a bigint, b bigint")


def bit_matrix(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(f.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(prints: DataFrame) -> np.ndarray:
    """How often each two bits are set together, and each bit at all (last row), over all fingerprints: 65 x 65 sums for
    each task are added up."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS + 1, BITS + 1), np.int64)
        for pdf in batches:
            b = np.concatenate([bit_matrix(pdf["f"].to_numpy()), np.ones((len(pdf), 1), np.uint8)], axis=1).astype(np.float64)
            total += (b.T @ b).astype(np.int64)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j]})

    sums = prints.select("f").mapInPandas(moments, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    m = np.zeros((BITS + 1, BITS + 1))
    for r in sums:
        m[r["i"], r["j"]] = r["n"]
    return m


def correlated_parts(m: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size: each group starts at the most uneven free bit and takes the
    bits most correlated with it."""
    n = max(m[BITS, BITS], 1)
    mean = m[BITS, :BITS] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    correlation = np.abs(m[:BITS, :BITS] / n - np.outer(mean, mean)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = len(free) // (parts - g)
        seed = min(free, key=lambda b: (spread[b], b))
        group = sorted(sorted(free), key=lambda b: (-correlation[seed, b] if b != seed else -2, b))[:width]
        groups.append(sorted(group))
        free -= set(group)
    return groups


def part_value(f: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of one part, packed into a number."""
    f = f.view(np.uint64)
    out = np.zeros(len(f), np.int64)
    for k, b in enumerate(bits):
        out |= ((f >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def estimated_candidates(prints: DataFrame, groups: list[list[int]], most: int) -> list[list[float]]:
    """For each part, the estimated cost of thresholds 0 .. ``most``.

    From the histograms of part values over all fingerprints come, inside Spark, the pairs with equal values; pairs at a
    distance are estimated from them by the growth of the Hamming ball. Probes are counted at PROBE_COST each.
    """

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pdf["f"].to_numpy()
            for g, bits in enumerate(groups):
                v, n = np.unique(part_value(f, bits), return_counts=True)
                yield pd.DataFrame({"g": g, "v": v, "n": n})

    counted = prints.select("f").mapInPandas(values, "g int, v bigint, n bigint").groupBy("g", "v").agg(F.sum("n").alias("n"))
    equal = {r["g"]: (float(r["p"]), float(r["m"])) for r in counted.groupBy("g").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("p"), F.sum("n").alias("m")).collect()}
    out = []
    for g, bits in enumerate(groups):
        pairs, rows = equal.get(g, (0.0, 0.0))
        ball, costs = 0.0, []
        for t in range(most + 1):
            ball += float(np.prod([len(bits) - i for i in range(t)]) / max(1, np.prod(range(1, t + 1))))
            costs.append(pairs / 2 * ball + PROBE_COST * rows * ball)
        out.append(costs)
    return out


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least cost, each -1 or more, with sum radius - parts + 1; by dynamic programming over the parts."""
    target = radius - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, len(part)):
                entry = (cost + (part[t] if t >= 0 else 0.0), [*chosen, t])
                if total + t not in step or entry < step[total + t]:
                    step[total + t] = entry
        best = step
    return best[target]


def plan(prints: DataFrame, radius: int) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds of least estimated cost, over 3 to radius + 1 parts."""
    options, moments = [], bit_moments(prints)
    for parts in range(3, radius + 2) if radius >= 2 else [radius + 1]:
        groups = correlated_parts(moments, parts)
        cost, thresholds = allocate(estimated_candidates(prints, groups, max(0, radius - parts + 1)), radius)
        options.append((cost, groups, thresholds))
    return min(options)[1:]


def links_in(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one bucket, by comparing rows of pairs at a time."""
    label = np.arange(len(f))
    a, b = [], []
    for i in range(len(f) - 1):
        near = np.flatnonzero((np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) & (label[i + 1 :] != label[i])) + i + 1
        for other, j in zip(*np.unique(label[near], return_index=True)):
            a.append(f[i])
            b.append(f[near[j]])
            label[label == other] = label[i]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def bucket_links(keys: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the fingerprints that share a key; keys are sorted. Small buckets are compared together, by shifts."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        x, y = links_in(f[s : s + n], radius)
        a.append(x)
        b.append(y)
    small = np.repeat(sizes <= 64, sizes)
    k, g = keys[small], f[small]
    for d in range(1, 64):
        same = k[d:] == k[:-d]
        if not same.any():
            break
        near = same & (np.bitwise_count(g[d:] ^ g[:-d]) <= radius)
        a.append(g[:-d][near])
        b.append(g[d:][near])
    return np.concatenate([*a, np.array([], np.uint64)]), np.concatenate([*b, np.array([], np.uint64)])


def masks(bits: list[int], most: int) -> np.ndarray:
    """All ways to flip up to ``most`` of the bits."""
    return np.array([sum(1 << b for b in c) for r in range(most + 1) for c in combinations(bits, r)], np.uint64)


def near_links(prints: DataFrame, radius: int = RADIUS, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``f``), enough to connect all that are linked.

    A bucket is all fingerprints that reach one probed value of one part. Buckets are counted first. Those of up to
    ``large_bucket`` are compared pair by pair, one bucket in memory at a time. In larger ones pairs would grow with the
    square: there each fingerprint is written under every value within radius / 2 flips (of any bit), and
    fingerprints that meet at a value are linked in a chain. Two fingerprints meet if and only if they are within the
    radius, so no link is lost and none is added; the rows grow in proportion to the bucket. Half the radius is rounded
    up on one side for odd radii.
    """
    groups, thresholds = plan(prints, radius)
    probes = [(g, bits, masks(list(range(len(bits))), t)) for g, (bits, t) in enumerate(zip(groups, thresholds)) if t >= 0]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pdf["f"].to_numpy()
            for g, bits, flips in probes:
                value = part_value(f, bits)
                # f itself is indexed under its value; as a probe it only visits values that are larger than its own
                for k, flip in enumerate(flips.astype(np.int64)):
                    at = value ^ flip
                    keep = slice(None) if k == 0 else at > value
                    yield pd.DataFrame({"key": (np.int64(g) << 58) ^ at[keep], "f": f[keep], "home": k == 0})

    probed = prints.select("f").mapInPandas(probe, "key bigint, f bigint, home boolean")
    if any(len(flips) > 1 for _, _, flips in probes):
        probed = spool(probed)
    # a bucket without a second fingerprint, or without one at home, has no pair to compare
    sizes = probed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home")).where("n > 1 and home")
    sizes = spool(sizes)
    hot = sizes.where(F.col("n") > large_bucket)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(keys, f.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, f = np.array([], np.int64), np.array([], np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            f = np.concatenate([f, batch.column(1).to_numpy()])
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if done:
                yield found(keys[:done], f[:done])
                keys, f = keys[done:], f[done:]
        if len(keys):
            yield found(keys, f)

    modest = probed.select("key", "f").join(sizes.where(F.col("n") <= large_bucket).select("key"), "key", "left_semi")
    pairs = modest.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a bigint, b bigint")
    if not hot.limit(1).count():
        return pairs.distinct()
    return pairs.union(half_way_links(probed.select("key", "f").join(hot.select("key"), "key", "left_semi").select("f").distinct(), radius)).distinct()


def half_way_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links of all ``prints`` by meeting half way: chains over the fingerprints that meet at a value.

    For an even radius each fingerprint visits all values within radius / 2; two visit a common value exactly if they
    are within the radius. For an odd one the half is rounded down and each fingerprint also visits, as a guest, the
    values one flip further; guests are linked to residents only.
    """
    near = masks(list(range(BITS)), radius // 2)
    far = masks(list(range(BITS)), radius // 2 + 1)[len(near) :] if radius % 2 else np.array([], np.uint64)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf["f"].to_numpy():
                at = np.concatenate([near, far]) ^ np.array([f]).view(np.uint64)
                yield pd.DataFrame({"at": at.view(np.int64), "f": f, "guest": np.arange(len(at)) >= len(near)})

    visits = prints.mapInPandas(visit, "at bigint, f bigint, guest boolean")
    hosts = visits.where("not guest").groupBy("at").agg(F.min("f").alias("host"))
    return visits.join(hosts, "at").where("f <> host").select(F.col("host").alias("a"), F.col("f").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(id, fingerprint, component): one row for each row of ``df``; component is the smallest id reachable.

    Texts are linked whose fingerprints over shingles of ``width`` words differ in ``radius`` bits at most; or, with a
    ``similarity``, those whose sets of shingles have that Jaccard similarity at least (``radius`` is not used then).

    Null texts count as empty, and texts without words have the fingerprint zero, which links like any other (with a
    ``similarity``: to each other only). Rows with a null id get a fingerprint but neither give nor receive a component
    (null). Repeated ids are one node: all their texts' links count. Other columns are not looked at. An empty table
    gives an empty result.
    """
    at = "f" if similarity is None else "s"
    rows = spool(with_fingerprints(df, id_col, text_col, width) if similarity is None else with_shingle_sets(df, id_col, text_col, width))
    known = rows.where("id is not null")
    prints = spool(known.groupBy(at).agg(F.min("id").alias("least")))  # copies and equal fingerprints are one node
    links = near_links(prints, radius) if similarity is None else spool(similar_links(known, df.select(F.col(text_col).alias("text")), similarity, width))
    to_id = prints.select(F.col(at).alias("pf"), F.col("least").alias("pid"))
    by_id = links.join(to_id, F.col("a") == F.col("pf")).select(F.col("pid").alias("a"), "b")
    by_id = by_id.join(to_id, F.col("b") == F.col("pf")).select("a", F.col("pid").alias("b"))
    several = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")  # ids with several texts
    joined = known.join(several, "id", "left_semi").join(to_id, F.col(at) == F.col("pf")).select(F.col("id").alias("a"), F.col("pid").alias("b"))
    components = connected_components(by_id.union(joined))
    home = prints.select(at, "least").join(components, F.col("least") == F.col("node"), "left").select(F.col(at).alias("hf"), F.coalesce("component", "least").alias("component"))
    return rows.join(home, F.col(at) == F.col("hf"), "left").select(
        F.col("id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component")
    )


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))
