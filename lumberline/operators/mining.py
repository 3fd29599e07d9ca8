"""Template mining: an exact, parallel form of the Drain tree.

Lines only ever meet clusters of their own leaf, and a leaf follows from the first occurrences of keys, so the tree needs
no shared state: one pass gives the first line of each path of keys, the children that nodes keep follow from that table,
lines are dealt by leaf, and each leaf replays its lines in order with nothing in memory but its clusters. Ids follow the
order of birth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.masking import split_tokens, tokens_of
from ..sources.spool import release, spooled

WILD = "<*>"
EMPTY = "<EMPTY>"
#: Clusters of a leaf that are compared one by one; more are compared together.
FEW_CLUSTERS = 32
#: Contents that a leaf remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 65_536, 64 << 20


@dataclass(frozen=True)
class DrainConfig:
    """``max_children``: keys of a node, whose later ones share "*". ``max_clusters``: templates of a document, whose later
    lines join the most similar one. None: no limit, so that each path has its leaf and each unlike line its template."""

    depth: int = 4
    similarity: float = 0.5
    max_children: int | None = 100
    max_clusters: int | None = 20_000

    def __post_init__(self):
        if self.depth < 3:
            raise ValueError("depth must be at least 3")


@dataclass
class Cluster:
    birth: int
    template: list[str]
    size: int = 1
    wild: int = 0


def similarity(tokens: list[str], template: list[str]) -> float:
    """Share of equal positions; a wildcard counts half."""
    tenths = sum(10 if a == b else 5 if b == WILD else 0 for a, b in zip(tokens, template))
    return tenths / (10 * max(len(tokens), len(template)))


@dataclass
class SameLength:
    """Templates of one length as rows of numbers."""

    codes: np.ndarray
    wild: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)

    def append(self, codes: list[int], wild: int, place: int) -> None:
        if len(self.places) == len(self.codes):
            self.codes = np.concatenate([self.codes, np.empty((max(1, len(self.codes)), len(codes)), np.int32)])
        self.codes[len(self.places)] = codes
        self.wild.append(wild)
        self.places.append(place)


class Templates:
    """All templates of a leaf as tables of numbers, one for each length, that a line is compared with at once."""

    def __init__(self):
        self.numbers = {WILD: 0}
        self.tables: dict[int, SameLength] = {}
        self.rows: list[tuple[SameLength, int]] = []  # where each cluster stands

    def append(self, cluster: Cluster) -> None:
        codes = [self.numbers.setdefault(t, len(self.numbers)) for t in cluster.template]
        table = self.tables.setdefault(len(codes), SameLength(np.empty((0, len(codes)), np.int32)))
        self.rows.append((table, len(table.places)))
        table.append(codes, cluster.wild, len(self.rows) - 1)

    def widen(self, place: int, at: int) -> None:
        """The cluster's position ``at`` is a wildcard from now on."""
        table, row = self.rows[place]
        table.codes[row, at] = 0
        table.wild[row] += 1

    def nearest(self, tokens: list[str]) -> tuple[int | None, float]:
        line = np.array([self.numbers.get(t, -1) for t in tokens], np.int32)
        best, score = None, -1.0
        for n, table in self.tables.items():
            shared = min(n, len(line))
            codes = table.codes[: len(table.places), :shared]
            same = codes == line[:shared]
            tenths = 10 * same.sum(1) + 5 * ((codes == 0) & ~same).sum(1)
            s = tenths / (10 * max(n, len(line)))
            s[(10 * np.array(table.wild) > 7 * n) & (s < 0.8)] = -1.0
            i = int(s.argmax())  # the first of equal ones
            if s[i] >= 0 and (s[i] > score or (s[i] == score and table.places[i] < best)):
                best, score = table.places[i], float(s[i])
        return best, score


@dataclass
class Leaf:
    """The clusters of one leaf, in order of birth, and a memo that holds while no template changes."""

    config: DrainConfig
    overflow: bool
    stop: int | None = None  # from this line on no cluster may be born
    clusters: list[Cluster] = field(default_factory=list)
    memo: dict[str, Cluster | None] = field(default_factory=dict)
    templates: Templates = field(default_factory=Templates)  # of the clusters, once there are many
    remembered: int = 0

    def nearest(self, tokens: list[str]) -> tuple[int | None, float]:
        """The most similar cluster's place, the first of equal ones, and its similarity."""
        if len(self.clusters) > FEW_CLUSTERS:
            for c in self.clusters[len(self.templates.rows) :]:
                self.templates.append(c)
            return self.templates.nearest(tokens)
        best, score = None, -1.0
        for i, c in enumerate(self.clusters):
            s = similarity(tokens, c.template)
            if s > score and not (10 * c.wild > 7 * len(c.template) and s < 0.8):
                best, score = i, s
        return best, score

    def add(self, line_no: int, content: str) -> int | None:
        """The birth line of the cluster that the line joins (its own for a new one); None for the blank cluster."""
        if content in self.memo:
            found = self.memo[content]
            if found:
                found.size += 1
            return found.birth if found else None
        tokens = split_tokens(content)
        place, score = self.nearest(tokens)
        best = None if place is None else self.clusters[place]
        born = self.stop is None or line_no < self.stop
        if best is None and not born:
            self._remember(content, None)
            return None
        if best is not None and (score >= (0.0 if self.overflow else self.config.similarity) or not born):
            best.size += 1
            changed = False
            for i, (a, b) in enumerate(zip(best.template, tokens)):
                if a != b and a != WILD:
                    best.template[i] = WILD
                    best.wild += 1
                    if place < len(self.templates.rows):
                        self.templates.widen(place, i)
                    changed = True
            if changed:
                self.forget()
            else:
                self._remember(content, best)
            return best.birth
        self.clusters.append(Cluster(line_no, tokens, wild=tokens.count(WILD)))
        self.forget()
        return line_no

    def forget(self) -> None:
        self.memo.clear()
        self.remembered = 0

    def _remember(self, content: str, cluster: Cluster | None) -> None:
        if len(self.memo) < REMEMBERED and self.remembered + len(content) <= REMEMBERED_CHARS:
            self.memo[content] = cluster
            self.remembered += len(content)


def with_keys(lines: DataFrame, config: DrainConfig) -> DataFrame:
    """``lines`` with the keys that lead to a line's leaf (``__k0``, ...): its number of tokens, then its first ones. Blank
    lines have none."""
    t = F.col("__t")
    keys = [F.size(t).cast("string")] + [F.coalesce(F.get(t, F.lit(i)), F.lit("*")) for i in range(config.depth - 2)]
    rows = lines.withColumn("__t", tokens_of(F.col("content")))
    return rows.select(*lines.columns, *[F.when(F.size(t) > 0, k).alias(f"__k{i}") for i, k in enumerate(keys)])


CHILD = StructType([StructField("level", IntegerType()), StructField("path", StringType()), StructField("key", StringType()), StructField("first", LongType())])
#: Paths of keys (and children known before) up to which the driver goes through the levels: a few MB.
FEW_PATHS = 20_000


def few_levels(paths: list[tuple], config: DrainConfig, before: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """What ``route`` gives, of few paths (doc_id, key, ..., first line): rows of leaves, and of children."""
    rows = [(*p[:-1], "", False) for p in paths]
    firsts, kept = [p[-1] for p in paths], []
    for level in range(config.depth - 1):
        first: dict[tuple, int] = {(d, path, key): n for d, at, path, key, n in before if at == level}
        for r, n in zip(rows, firsts):
            node = (r[0], r[-2], r[1 + level])
            first[node] = min(n, first.get(node, n))
        own: dict[tuple, int] = {}
        held = set()
        for node, n in sorted(first.items(), key=lambda x: x[1]):
            own[node[:2]] = own.get(node[:2], 0) + 1
            if own[node[:2]] <= config.max_children:
                held.add(node)
                kept.append((node[0], level, node[1], node[2], n))
        for i, r in enumerate(rows):
            key = r[1 + level]
            there = (r[0], r[-2], key) in held or key == "*"
            leaf = f"{r[-2]}\u0001{key if there else '*'}"
            rows[i] = (*r[:-2], leaf, r[-1] or (level > 0 and not there))
    return rows, kept


def route(keyed: DataFrame, config: DrainConfig, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The leaf of each path of keys (doc_id, __k0, ..., leaf, overflow), and of each level the children that nodes keep
    (doc_id, level, path, key, first). Both are written.

    At each level a node keeps its first ``max_children`` keys, by first occurrence; later ones share "*". Lines are read
    once, for the first occurrence of each path; the levels work on that table alone, and ranking stops at the limit inside
    each task. Few paths are gone through on the driver. ``before`` are the children kept of earlier lines.
    """
    names = [c for c in keyed.columns if c.startswith("__k")]
    kinds = keyed.select("doc_id", *names).schema
    paths = spooled(keyed.where(F.col("__k0").isNotNull()).groupBy("doc_id", *names).agg(F.min("line_no").alias("__first")))
    if paths.limit(FEW_PATHS + 1).count() <= FEW_PATHS and (before is None or before.limit(FEW_PATHS + 1).count() <= FEW_PATHS):
        rows, kept = few_levels([tuple(r) for r in paths.collect()], config, [tuple(r) for r in before.collect()] if before is not None else [])
        release(paths)
        spark = keyed.sparkSession
        leaves = StructType([*kinds.fields, StructField("leaf", StringType()), StructField("overflow", BooleanType())])
        known = StructType([kinds["doc_id"], *CHILD.fields])
        return spark.createDataFrame(rows, leaves).coalesce(1), spooled(spark.createDataFrame(kept, known).coalesce(1))
    out, children, written = paths.withColumns({"leaf": F.lit(""), "overflow": F.lit(False)}), None, [paths]
    narrow = None
    if before is None:  # documents whose paths are so few that no node can have too many children keep all keys
        wide = spooled(paths.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__paths")).where(F.col("__paths") > config.max_children).select(F.col("doc_id").alias("__d")))
        of_wide = F.col("doc_id").eqNullSafe(F.col("__d"))
        narrow = out.join(wide, of_wide, "left_anti")
        out = out.join(wide, of_wide, "left_semi")
        written.append(wide)
        steps = F.array(*[F.struct(F.lit(i).alias("level"), F.concat_ws("\u0001", F.lit(""), *names[:i]).alias("path"), F.col(n).alias("key")) for i, n in enumerate(names)])
        children = narrow.select("doc_id", F.explode(steps).alias("__s"), "__first").groupBy("doc_id", "__s.level", "__s.path", "__s.key").agg(F.min("__first").alias("first"))
        narrow = narrow.withColumn("leaf", F.concat_ws("\u0001", "leaf", *names))
    for i, name in enumerate(names):
        key = F.col(name)
        first = out.groupBy("doc_id", F.col("leaf").alias("path"), key.alias("key")).agg(F.min("__first").alias("first"))
        if before is not None:
            known = before.where(F.col("level") == i).select("doc_id", "path", "key", "first")
            first = first.union(known).groupBy("doc_id", "path", "key").agg(F.min("first").alias("first"))
        rank = Window.partitionBy("doc_id", "path").orderBy("first")
        kept = spooled(first.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= config.max_children).select("doc_id", F.lit(i).alias("level"), "path", "key", "first"))
        written.append(kept)
        children = kept if children is None else children.union(kept)
        own = kept.select(F.col("doc_id").alias("__d"), F.col("path").alias("__l"), F.col("key").alias("__key"), F.lit(True).alias("__own"))
        out = out.join(own, (F.col("doc_id") == F.col("__d")) & (F.col("leaf") == F.col("__l")) & (key == F.col("__key")), "left")
        step = F.col("__own").isNotNull() | (key == "*")
        overflow = F.col("overflow") | (~step if i else F.lit(False))
        out = out.withColumns({"leaf": F.concat_ws("\u0001", "leaf", F.when(step, key).otherwise(F.lit("*"))), "overflow": overflow}).drop("__d", "__l", "__key", "__own")
    done = spooled((out if narrow is None else narrow.union(out)).drop("__first")), spooled(children)
    for table in written:
        release(table)
    return done


#: Lines of a leaf that are looked up in its memo together; so few are looked up one by one.
TOGETHER, FEW_LINES = 4096, 8


def _replayed(leaf: Leaf, lines: np.ndarray, codes: np.ndarray, contents: list[str], overflow: np.ndarray) -> np.ndarray:
    """The births that a leaf's next lines join (-1: the blank cluster). Stretches whose contents are all in the memo change
    nothing but sizes, so they are looked up by their distinct contents."""
    out = np.empty(len(lines), np.int64)
    for lo in range(0, len(lines), TOGETHER):
        here = slice(lo, lo + TOGETHER)
        if len(lines) > FEW_LINES and (overflow[here] == leaf.overflow).all():
            distinct, place, counts = np.unique(codes[here], return_inverse=True, return_counts=True)
            found = [leaf.memo.get(contents[c], leaf) for c in distinct]
            if leaf not in found:
                for cluster, n in zip(found, counts.tolist()):
                    if cluster:
                        cluster.size += n
                out[here] = np.array([c.birth if c else -1 for c in found], np.int64)[place]
                continue
        for i in range(lo, min(lo + TOGETHER, len(lines))):
            if leaf.overflow != overflow[i]:
                leaf.overflow = bool(overflow[i])
                leaf.forget()
            birth = leaf.add(int(lines[i]), contents[codes[i]])
            out[i] = -1 if birth is None else birth
    return out


REPLAYED = StructType([StructField("doc_id", StringType()), StructField("leaf", StringType()), StructField("line_no", LongType()), StructField("birth", LongType()), StructField("template", StringType()), StructField("size", LongType())])


def joined(column: dict[str, pa.Array], new: np.ndarray, births: np.ndarray) -> pa.RecordBatch:
    """The rows of the lines of a batch that are ``new``."""
    none = lambda t: pa.nulls(len(births), t)
    found = [column["doc_id"], none(pa.string()), column["line_no"], pa.array(births, pa.int64(), mask=births < 0), none(pa.string()), none(pa.int64())]
    return pa.RecordBatch.from_arrays([c.filter(pa.array(new)) for c in found], [f.name for f in REPLAYED])


def replayed_batches(batches: Iterator[pa.RecordBatch], config: DrainConfig, births_too: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows of ``replay`` from its sorted rows. A batch gives one batch of its lines (with ``births_too``) and one of the
    clusters of the leaves that end in it, however short its leaves are."""
    at, leaf, like, blank = None, None, None, 0
    ended: list[tuple] = []  # document, leaf, birth, template, size

    def end() -> None:
        if leaf is not None and at[1] is None:
            ended.append((*at, None, EMPTY, blank))
        elif leaf is not None:  # without clusters if births were forbidden before its first line
            ended.extend((*at, c.birth, " ".join(c.template), c.size) for c in leaf.clusters)

    def finals() -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*ended), (like, pa.string(), pa.int64(), pa.string(), pa.int64()))]
        ended.clear()
        return pa.RecordBatch.from_arrays([*columns[:2], pa.nulls(len(columns[0]), pa.int64()), *columns[2:]], [f.name for f in REPLAYED])

    for b in batches:
        if not b.num_rows:
            continue
        column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        like = column["doc_id"].type
        coded = {c: column[c].dictionary_encode() for c in ("doc_id", "leaf", "content")}
        code = {c: x.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c, x in coded.items()}
        doc_names, leaf_names, contents = (coded[c].dictionary.to_pylist() for c in ("doc_id", "leaf", "content"))
        flags = column["overflow"].to_numpy(zero_copy_only=False)
        old = column["line_no"].is_null().to_numpy(zero_copy_only=False)
        lines = column["line_no"].fill_null(-1).to_numpy(zero_copy_only=False)
        births = np.full(b.num_rows, -1, np.int64)
        cuts = np.flatnonzero((np.diff(code["doc_id"]) != 0) | (np.diff(code["leaf"]) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            d = int(code["doc_id"][lo])
            n = int(code["leaf"][lo])
            place = (doc_names[d] if d >= 0 else None, leaf_names[n] if n >= 0 else None)
            if place != at:
                end()
                at, leaf, blank = place, Leaf(config, False, column["stop"][lo].as_py()), 0
            if n < 0:
                blank += hi - lo
                continue
            while lo < hi and old[lo]:
                tokens = contents[code["content"][lo]].split(" ")
                leaf.clusters.append(Cluster(column["birth"][lo].as_py(), tokens, column["size"][lo].as_py(), tokens.count(WILD)))
                lo += 1
            if lo < hi:
                births[lo:hi] = _replayed(leaf, lines[lo:hi], code["content"][lo:hi], contents, flags[lo:hi])
        if births_too:
            yield joined(column, ~old, births)
        if ended:
            yield finals()
    end()
    if ended:
        yield finals()


def replay(routed: DataFrame, config: DrainConfig, stops: DataFrame | None = None, known: DataFrame | None = None, births_too: bool = True) -> DataFrame:
    """(doc_id, leaf, line_no, birth, template, size): of each line of ``routed`` (doc_id, leaf, overflow, line_no, content)
    the birth line of its cluster (null: the blank cluster); and of each cluster a row without ``line_no`` that has its final
    ``template`` and ``size``. Lines without a leaf are blank; a document's have one row like a cluster's, without ``birth``.
    Rows of lines are left out without ``births_too``.

    Only these narrow rows are shuffled. Lines of a leaf stand together, sorted, and stream through; memory is the leaf's
    clusters and a batch. ``known`` (doc_id, leaf, birth, template, size) are clusters of earlier lines; they come before the
    lines of their leaf.
    """
    kind = routed.schema["doc_id"].dataType
    rows = routed.select("doc_id", "leaf", "line_no", "overflow", "content", F.lit(None).cast("long").alias("birth"), F.lit(None).cast("long").alias("size"))
    if known is not None:
        rows = rows.union(known.select("doc_id", "leaf", F.lit(None).cast("long"), F.lit(False), F.col("template"), "birth", "size"))
    rows = rows.join(stops.withColumnRenamed("doc_id", "__d"), F.col("doc_id") == F.col("__d"), "left").drop("__d") if stops is not None else rows.withColumn("stop", F.lit(None).cast("long"))
    # the overflow flag is the leaf's: a "*" child that is shared by literal and late keys overflows for the late ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return replayed_batches(batches, config, births_too)

    dealt = rows.repartition("doc_id", "leaf").sortWithinPartitions("doc_id", "leaf", F.col("line_no").asc_nulls_first(), "birth")
    return dealt.mapInArrow(run, StructType([StructField("doc_id", kind), *REPLAYED.fields[1:]]))


@dataclass(frozen=True)
class Mined:
    """What mining has found: ``found`` (doc_id, line_no, birth) of the lines, and what later lines need. ``clusters``: doc_id,
    leaf, birth, template, size, nth; ``children``: those that nodes keep; ``blanks``: lines of the blank template by document.
    All are written; ``release`` deletes them."""

    found: DataFrame
    clusters: DataFrame
    children: DataFrame
    blanks: DataFrame

    @property
    def births(self) -> DataFrame:
        """doc_id, line_no, template_id of the lines that are in a cluster."""
        numbers = self.clusters.select(F.col("doc_id").alias("__d"), F.col("birth").alias("__b"), F.col("nth").cast("int").alias("template_id"))
        same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("birth") == F.col("__b"))
        return self.found.where("line_no is not null and birth is not null").join(numbers, same).select("doc_id", "line_no", "template_id")

    @property
    def templates(self) -> DataFrame:
        """doc_id, template_id, pattern, count, example_line; template ids follow the order of birth in each document."""
        found = self.clusters.select("doc_id", F.col("nth").cast("int").alias("template_id"), F.col("template").alias("pattern"), F.col("size").alias("count"), F.col("birth").alias("example_line"))
        return found.union(self.blanks.select("doc_id", F.lit(0), F.lit(EMPTY), "count", F.lit(0).cast("long")))

    def of(self, lines: DataFrame) -> DataFrame:
        """``lines`` with ``template_id``, by document and number."""
        own = self.births.select(F.col("doc_id").alias("__d"), F.col("line_no").alias("__n"), "template_id")
        joined = lines.join(own, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("line_no") == F.col("__n")), "left")
        return joined.select(*lines.columns, F.coalesce("template_id", F.lit(0)).alias("template_id"))

    def release(self) -> None:
        for table in (self.found, self.clusters, self.children, self.blanks):
            release(table)


def mine_on(lines: DataFrame, config: DrainConfig = DrainConfig(), before: Mined | None = None) -> Mined:
    """Mine ``lines`` (doc_id, line_no, content, ...), after those that ``before`` has.

    ``lines`` is evaluated once: numbers, contents and keys are written, and read twice, for the paths and for the replay.
    With more than ``max_clusters`` births in a document, leaves are replayed with births forbidden from the first line that
    may not have one.
    """
    return mine_keyed(spooled(with_keys(lines.select("doc_id", "line_no", "content"), config)), config, before, True)


def mine_keyed(keyed: DataFrame, config: DrainConfig = DrainConfig(), before: Mined | None = None, own: bool = False) -> Mined:
    """``mine_on`` of a written table of lines ``with_keys``; with ``own`` it is deleted afterwards."""
    names = [c for c in keyed.columns if c.startswith("__k")]
    routed = keyed.where(F.col("__k0").isNotNull())
    if config.max_children is None:  # each path of keys is a leaf, and no child has to be known later
        leaves, children = None, keyed.sparkSession.createDataFrame([], StructType([keyed.schema["doc_id"], *CHILD.fields]))
        routed = routed.withColumns({"leaf": F.concat_ws("\u0001", F.lit(""), *names), "overflow": F.lit(False)})
    else:
        leaves, children = route(keyed, config, before.children if before else None)
        to = leaves.select(F.col("doc_id").alias("__d"), *[F.col(n).alias(f"_{n}") for n in names], "leaf", "overflow")
        same = F.col("doc_id").eqNullSafe(F.col("__d"))
        for n in names:
            same = same & (F.col(n) == F.col(f"_{n}"))
        routed = routed.select("doc_id", "line_no", "content", *names).join(to, same)
    routed = routed.select("doc_id", "leaf", "overflow", "line_no", "content")
    known = before.clusters if before else None
    rank = Window.partitionBy("doc_id").orderBy("birth")

    def ranked(found: DataFrame) -> DataFrame:
        return spooled(found.where("line_no is null").select("doc_id", "leaf", "birth", "template", "size", F.row_number().over(rank).alias("nth")))

    found = spooled(replay(routed, config, None, known))
    clusters = ranked(found)  # a row for each template
    over = clusters.where(F.col("nth") == F.lit(config.max_clusters)).select("doc_id", F.col("birth").alias("stop"))
    if config.max_clusters is not None and over.limit(1).count():
        again = spooled(replay(routed, config, over, known))
        release(found)
        release(clusters)
        found, clusters = again, ranked(again)
    joined = found.where("line_no is not null and birth is not null").groupBy("doc_id").agg((-F.count(F.lit(1))).alias("count"))
    blanks = keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count")).union(joined)
    if before:
        blanks = blanks.union(before.blanks)
    blanks = spooled(blanks.groupBy("doc_id").agg(F.sum("count").alias("count")))
    for table in (*([leaves] if leaves else []), *([keyed] if own else [])):
        release(table)
    return Mined(found, clusters, children, blanks)


def mine(lines: DataFrame, config: DrainConfig = DrainConfig()) -> tuple[DataFrame, DataFrame]:
    """(``lines`` with ``template_id``, templates), by ``mine_on``; 0 is the blank template."""
    found = mine_on(lines, config)
    return found.of(lines), found.templates


def templates_of(lines: DataFrame, config: DrainConfig = DrainConfig(max_children=None, max_clusters=None)) -> DataFrame:
    """The templates of ``mine`` alone, without limits: lines are read once and nothing is written but two shuffles."""
    if config.max_children is not None or config.max_clusters is not None:
        raise ValueError("templates alone are mined without limits")
    keyed = with_keys(lines.select("doc_id", "line_no", "content"), config)
    names = [c for c in keyed.columns if c.startswith("__k")]
    leaf = F.when(F.col("__k0").isNotNull(), F.concat_ws("\u0001", F.lit(""), *names))
    found = replay(keyed.select("doc_id", leaf.alias("leaf"), F.lit(False).alias("overflow"), "line_no", "content"), config, births_too=False)
    order = Window.partitionBy("doc_id").orderBy(F.col("birth").asc_nulls_first())  # the blank template is first, where there is one
    blank = F.first("birth").over(order).isNull()
    numbered = found.select("doc_id", (F.row_number().over(order) - blank.cast("int")).alias("template_id"), (~blank & (F.row_number().over(order) == 1)).alias("__first"), F.col("template").alias("pattern"), F.col("size").alias("count"), F.coalesce("birth", F.lit(0)).alias("example_line"))
    own = F.struct("template_id", "pattern", "count", "example_line")
    none = F.struct(F.lit(0).alias("template_id"), F.lit(EMPTY).alias("pattern"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("example_line"))
    rows = numbered.select("doc_id", F.explode(F.when(F.col("__first"), F.array(none, own)).otherwise(F.array(own))).alias("__t"))
    return rows.select("doc_id", "__t.*")


class Tree:
    """The same by one pass over an ordinary tree: for tests, small samples and lines that arrive one by one."""

    def __init__(self, config: DrainConfig = DrainConfig()):
        self.config, self.root = config, {}
        self.clusters: list[Cluster] = []
        self.numbers: dict[int, int] = {}
        self.lines = 0

    def add(self, content: str) -> int:
        """The template id of the next line."""
        n, self.lines = self.lines, self.lines + 1
        tokens = split_tokens(content)
        if not tokens:
            return 0
        node, overflow = self.root, False
        path = [str(len(tokens))] + [tokens[i] if i < len(tokens) else "*" for i in range(self.config.depth - 2)]
        for level, key in enumerate(path):
            if key not in node and key != "*" and self.config.max_children is not None and len(node) >= self.config.max_children:
                key, overflow = "*", overflow or level > 0
            node = node.setdefault(key, {})
        leaf = node.setdefault("leaf", Leaf(self.config, overflow))
        stop = 0 if self.config.max_clusters is not None and len(self.clusters) + 1 >= self.config.max_clusters else None
        if (leaf.overflow, leaf.stop) != (overflow, stop):
            leaf.overflow, leaf.stop = overflow, stop
            leaf.forget()
        known = len(leaf.clusters)
        birth = leaf.add(n, " ".join(tokens))
        if len(leaf.clusters) > known:
            self.clusters.append(leaf.clusters[-1])
            self.numbers[n] = len(self.clusters)
        return 0 if birth is None else self.numbers[birth]

    @property
    def patterns(self) -> list[str]:
        return [EMPTY] + [" ".join(c.template) for c in self.clusters]


def mine_in_order(contents: list[str], config: DrainConfig = DrainConfig()) -> tuple[list[int], list[str]]:
    """(template ids, patterns) of lines in order."""
    tree = Tree(config)
    return [tree.add(c) for c in contents], tree.patterns


def template_counts(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Counts in a view: every template, 0 where it has no line."""
    counts = lines.groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))
    return templates.drop("count").join(counts, "template_id", "left").withColumn("count", F.coalesce("n", F.lit(0))).drop("n")


def degraded(templates: DataFrame) -> DataFrame:
    """Templates of which more than 70 % are wildcards."""
    words = F.split("pattern", " ")
    return templates.where(10 * F.size(F.filter(words, lambda w: w == WILD)) > 7 * F.size(words))


__all__ = ["DrainConfig", "Mined", "Tree", "degraded", "mine", "mine_in_order", "mine_keyed", "mine_on", "replay", "route", "template_counts", "templates_of", "with_keys"]
