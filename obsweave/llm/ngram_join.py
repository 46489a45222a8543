"""N-gram Jaccard join with token-combination prefixes.

Tokens are a document's distinct word shingles.  All documents order them alike:
rare ones first, frequent ones last, by hash within.  Two documents that link
share at least ``need`` tokens, so they share one among the first ``size - need
+ 1`` of either.  A rare token there is indexed by itself.  Frequent tokens fall
into classes, the more the longer the text; the prefix is extended by as many
tokens, and where all shared tokens in it are frequent, two of them are of one
class: pairs within a class are indexed.  Documents with equal sets stand for one
another.

Who meets under a key is verified on whole texts: first each document against
one centre, the most ordinary document it meets most often; then, round by round,
against one member of another component, as long as that makes much fewer pairs
of those that are left; at last, across the components that remain, whoever still
meets.  Members of one component are never paired, so a group of near copies
costs about its size, and no link between components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm import wordhash
from obsweave.llm.common import few_tasks, kept, release_arrow_memory, whole_text
from obsweave.llm.components import components

FREQUENT = 32  # documents that make a token frequent
FREQUENT_TOKENS = 2_000_000  # frequent tokens that tasks hold (16 MB); beyond, only the more frequent count
CLASSES = 8  # of the frequent tokens of a short text
CLASS_TOKENS = 50  # of a longer text's prefix a class may hold
ROUND_PAIRS = 100  # pairs a document, counted under each key, that may be left without a further round
ROUND_GAIN = 0.9  # a round must leave at most this part of the pairs, or it was the last
BUCKET_TOKENS = 2_000_000  # tokens that one counting task takes
PAIRS_A_TASK = 1_000  # compared, about a millisecond each
FLUSH_TOKENS = 1_000_000  # tokens that a counting task holds before it sends them
BROADCAST_IDS = 2_000_000  # ids (16 MB) up to which texts are looked up without a shuffle


@dataclass(frozen=True)
class Similarity:
    """Shingle width, and the Jaccard similarity in percent that links."""

    width: int = 5
    percent: int = 80

    def need(self, size: int) -> int:
        """Tokens that a set of this size shares at least with any it links to."""
        return -(-self.percent * size // 100)

    def links(self, shared: int, size_a: int, size_b: int) -> bool:
        return 100 * shared >= self.percent * (size_a + size_b - shared) and shared > 0


def _sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    for hashes in wordhash.words(texts):
        yield wordhash.shingle_set(hashes, width)


def identity(id_col: str, text_col: str) -> Column:
    """The id; where it is null, one that rows of equal text share, made of the text's hash."""
    stand_in = F.bitwise_not(F.abs(F.shiftright(F.xxhash64(whole_text(text_col)), 1)))
    return F.coalesce(F.col(id_col).cast("bigint"), stand_in)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``named, id, text, body``: ``id`` is never null, ``named`` tells whether it was, ``body`` is the text's hash."""
    return docs.select(
        F.col(id_col).isNotNull().alias("named"),
        identity(id_col, text_col).alias("id"),
        whole_text(text_col).alias("text"),
        F.xxhash64(whole_text(text_col)).alias("body"),
    )


def frequent_tokens(texts: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Fingerprints of the frequent tokens, ascending, and how far a token is shifted to get one.

    Every token of every document is counted.  A task sends its tokens as sorted
    blocks, one a range of hashes, with 24 bits of a token in it; ranges are as
    many as keep one to about ``BUCKET_TOKENS``, so that few tokens fall together
    at any size.  The set only orders tokens: any set gives the same links.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(total / 6 / BUCKET_TOKENS).bit_length())
    shift = 64 - bits - 24

    def blocks(pending: list[np.ndarray]) -> pd.DataFrame:
        marks = np.sort(np.concatenate(pending) >> np.uint64(shift))
        ranges = (marks >> np.uint64(24)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        low = marks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        return pd.DataFrame(
            {"range": ranges[starts], "block": [part.tobytes() for part in np.split(low, starts[1:])]}
        )

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, size = [], 0
        for batch in batches:
            for tokens in _sets(batch["text"].tolist(), width):
                pending.append(tokens)
                size += len(tokens)
                if size > FLUSH_TOKENS:
                    yield blocks(pending)
                    pending, size = [], 0
        if size:
            yield blocks(pending)
        release_arrow_memory()

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros(1 << 24, np.int32)
        for block in frame["block"]:
            parts = np.frombuffer(block, np.uint8).reshape(-1, 3).astype(np.int32)
            np.add.at(times, parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16, 1)
        often = np.flatnonzero(times >= FREQUENT)
        return pd.DataFrame({"mark": (key[0] << 24) | often, "docs": times[often]})

    sent = texts.select("text").mapInPandas(send, "range bigint, block binary")
    counted = kept(sent.groupBy("range").applyInPandas(count, "mark bigint, docs bigint"), "frequent")
    least = FREQUENT
    while counted.filter(F.col("docs") >= least).count() > FREQUENT_TOKENS:
        least *= 2
    marks = counted.filter(F.col("docs") >= least).select("mark").toPandas()["mark"].to_numpy(np.int64)
    return np.sort(marks.astype(np.uint64)), shift


def frequency_test(spark: SparkSession, marks: np.ndarray, shift: int):
    """A function that tasks call: which of some tokens are frequent."""
    held = spark.sparkContext.broadcast(marks)  # at most FREQUENT_TOKENS

    def is_frequent(tokens: np.ndarray) -> np.ndarray:
        marks, own = held.value, tokens >> np.uint64(shift)
        if not len(marks):
            return np.zeros(len(own), bool)
        return marks[np.minimum(np.searchsorted(marks, own), len(marks) - 1)] == own

    return is_frequent


def class_counts(size: int, similar: Similarity) -> list[int]:
    """In how many classes a set's frequent tokens are dealt, once for each number that a partner may go by.

    A pair goes by the larger of its sets; numbers change where sizes double, so
    that there are few.  They grow with the size, and keys grow no faster.
    """
    largest = 100 * size // similar.percent
    prefixes = ((1 << bits - 1) * (100 - similar.percent) // 100 for bits in range(max(1, size.bit_length()), max(1, largest.bit_length()) + 1))
    return sorted({max(CLASSES, prefix // CLASS_TOKENS) for prefix in prefixes})


def index_keys(tokens: np.ndarray, often: np.ndarray, similar: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """The keys a set is indexed by, and how many tokens it can share with whom it meets there first.

    ``often`` says which tokens are frequent.  Two sets first meet at their first
    shared token: what precedes it is not shared.  A set with pairs of frequent
    tokens is indexed by all its rare tokens, so sets that meet under such pairs
    only share no rare token; there the number is negative, as a mark.
    """
    size = len(tokens)
    need = similar.need(size)
    prefix = size - need + 1
    rare, frequent = tokens[~often], tokens[often]
    counts = class_counts(size, similar)
    if not len(frequent) or prefix + counts[-1] <= len(rare):
        own = rare[:prefix]
        return own, size - np.arange(len(own), dtype=np.int32)
    keys, most = [rare], [size - np.arange(len(rare), dtype=np.int32)]
    if need <= counts[-1]:  # too few shared tokens for two of a class
        keys.append(frequent[: max(0, prefix - len(rare))])
        most.append(len(frequent) - np.arange(len(keys[-1]), dtype=np.int32))
    for classes in counts:
        extended = frequent[: max(0, prefix + classes - len(rare))]
        of_class = extended % np.uint64(classes)
        salt = np.uint64(0 if classes == CLASSES else classes)
        for own in np.split(extended[np.argsort(of_class, kind="stable")], np.cumsum(np.bincount(of_class.astype(np.int64), minlength=classes))[:-1]):
            i, j = np.triu_indices(len(own), 1)
            keys.append(wordhash.scramble(own[i] * np.uint64(0x9FB21C651E98DF25) + own[j] + salt))
            most.append(np.full(len(i), -len(frequent), np.int32))
    return np.concatenate(keys), np.concatenate(most)


def described(texts: DataFrame, is_frequent, similar: Similarity) -> DataFrame:
    """``id, named, body, size, rare, s1, s2, keys, most`` of each row; ``s1, s2`` identify its set."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tokens in _sets(batch["text"].tolist(), similar.width):
                often = is_frequent(tokens)
                keys, most = index_keys(tokens, often, similar)
                first = int(np.bitwise_xor.reduce(wordhash.scramble(tokens), initial=np.uint64(0)))
                second = int(np.add.reduce(wordhash.scramble(tokens + np.uint64(1)), dtype=np.uint64))
                names = np.array([first, second], np.uint64).view(np.int64)
                rows.append((len(tokens), int((~often).sum()), *names, keys.view(np.int64), most.astype(np.int32)))
            out = pd.DataFrame(rows, columns=["size", "rare", "s1", "s2", "keys", "most"])
            yield pd.concat([batch[["id", "named", "body"]].reset_index(drop=True), out], axis=1)
        release_arrow_memory()

    schema = "id bigint, named boolean, body bigint, size int, rare int, s1 bigint, s2 bigint, keys array<bigint>, most array<int>"
    return texts.mapInPandas(describe, schema)


def _meetings(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The postings whose key several nodes have, with the key's centre: a node with the fewest rare tokens.

    Keys are counted by combining aggregates and joined to stored postings, so
    memory is bounded at any number of postings a partition and AQE can split the
    key that a third of all nodes have.
    """
    # Of all rows: copies of one set only add keys that fall below.
    often = rows.filter("size > 0").select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
    often = kept(often.filter("rows > 1").select("key"), "met-keys")
    spoken = rows.join(nodes.select("row"), "row")
    pair = F.explode(F.arrays_zip("keys", "most")).alias("pair")
    postings = spoken.select(F.col("id").alias("node"), "size", "rare", pair).select(
        "node", "size", "rare", F.col("pair.keys").alias("key"), F.col("pair.most").alias("most")
    )
    postings = kept(postings.join(often, "key"), "postings")
    # One number, so that the aggregate works in place; ties are as good as any.
    rank = F.shiftleft(F.col("rare").cast("bigint"), 32).bitwiseOR(F.hash("node").cast("bigint").bitwiseAND(0xFFFFFFFF))
    centres = postings.withColumn("rank", rank).groupBy("key").agg(
        F.count("*").alias("nodes"),
        *[F.min_by(c, "rank").alias(n) for c, n in (("node", "centre"), ("size", "centre_size"), ("most", "centre_most"))],
    )
    centres = kept(centres.filter("nodes > 1").drop("nodes"), "centres")
    met = postings.join(centres, "key")
    return met.select("key", "node", "size", "most", "centre", "centre_size", "centre_most")


def _compared(pairs: DataFrame, source: DataFrame, similar: Similarity, is_frequent) -> DataFrame:
    """The stored pairs ``a, b`` compared on whole texts.

    ``links``, the tokens they have ``shared``, and how many frequent ones of a
    lie ``outside`` of b.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for batch in batches:
            found = []
            others = _sets(batch["text_b"].tolist(), similar.width)
            for a, text, other in zip(batch["a"], batch["text_a"], others):
                if (a, text) != last:
                    last, own = (a, text), next(_sets([text], similar.width))
                within = np.isin(own, other, assume_unique=True)
                shared = int(within.sum())
                outside = int(is_frequent(own[~within]).sum())
                found.append((similar.links(shared, len(own), len(other)), shared, outside))
            out = pd.DataFrame(found, columns=["links", "shared", "outside"])
            yield pd.concat([batch[["a", "b"]].reset_index(drop=True), out], axis=1)
        release_arrow_memory()

    count = pairs.count()
    ids = kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids", 2 * count)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = kept(source.join(ids, "id", "left_semi").select(F.col("id").alias("node"), "text"), "texts")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    schema = "a bigint, b bigint, links boolean, shared int, outside int"
    return kept(few_tasks(both, count, PAIRS_A_TASK).mapInPandas(check, schema), "compared")


def _fits(a: str, b: str, similar: Similarity) -> Column:
    """What two sets can share at most is enough to link them; columns ``{a}size, {a}most, ...``."""
    return _enough(F.least(F.abs(f"{a}most"), F.abs(f"{b}most")), F.col(f"{a}size") + F.col(f"{b}size"), similar)


def _enough(shared: Column, sizes: Column, similar: Similarity) -> Column:
    return 100 * shared >= similar.percent * (sizes - shared)


def _stars(met: DataFrame, similar: Similarity) -> DataFrame:
    """Each node with the one centre that it meets under most keys."""
    counted = (
        met.filter((F.col("node") != F.col("centre")) & _fits("", "centre_", similar))
        .groupBy("node", "centre")
        .agg(F.count("*").alias("keys"))
    )
    best = counted.groupBy("node").agg(F.max_by("centre", F.struct("keys", -F.col("centre"))).alias("centre"))
    return best.select(F.col("node").alias("a"), F.col("centre").alias("b"))


def _split_keys(met: DataFrame, stars: DataFrame, roots: DataFrame, similar: Similarity) -> DataFrame:
    """The postings of keys that several components have, with ``root`` and the ``main`` one of the key.

    Without those that link to nobody under the key: what they can share at most
    does not do even for the smallest set there.
    """
    count = met.count()
    hubs = stars.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("shared").alias("inside"), "outside")
    placed = met.drop("centre_size", "centre_most").join(hubs, "node", "left").join(roots, "node", "left")
    placed = kept(placed.withColumn("root", F.coalesce("root", "node")), "placed", count)
    split = (
        placed.groupBy("key")
        .agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.max(F.when(F.col("node") == F.col("centre"), F.col("root"))).alias("main"),
            F.min("size").alias("smallest"),
        )
        .filter("low < high")
        .select("key", "main", "smallest")
    )
    may_link = _enough(F.abs("most"), F.col("size") + F.col("smallest"), similar)
    return kept(placed.join(split, "key").filter(may_link).drop("smallest"), "split-keys", count)


def _pairs_left(rows: DataFrame) -> tuple[int, int]:
    """At most how many pairs the split keys would give, and how many documents they hold."""
    sizes = rows.groupBy("key").agg(F.count_if(F.col("root") != F.col("main")).alias("few"), F.count("*").alias("rows"))
    pairs = sizes.agg(F.sum(F.col("few").cast("double") * F.col("rows"))).first()[0] or 0
    return pairs, rows.select("node").distinct().count() if pairs else 0


def _proposals(rows: DataFrame, done: DataFrame, similar: Similarity, turn: int) -> DataFrame:
    """For each document one of another component, of those it shares most keys with; none of ``done`` again.

    A key offers two members of different components, each key others and others
    each turn, so that a document finds those it shares most with.
    """
    draw = F.xxhash64("root", "key", F.lit(turn))
    member = F.struct("root", "node", "size", "most")
    offers = rows.groupBy("key").agg(F.min_by(member, draw).alias("one"), F.max_by(member, draw).alias("two"))
    other = F.when(F.col("one.root") != F.col("root"), F.col("one")).otherwise(F.col("two"))
    met = rows.join(offers, "key").withColumn("other", other).filter("other.root <> root")
    met = met.select("node", "size", "most", *[F.col(f"other.{c}").alias(f"other_{c}") for c in ("node", "size", "most")])
    counted = met.filter(_fits("", "other_", similar)).groupBy("node", "other_node").agg(F.count("*").alias("keys"))
    pairs = counted.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"), "node", "keys")
    pairs = pairs.join(done, ["a", "b"], "left_anti")
    best = pairs.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("keys", "a", "b")).alias("pair"))
    return best.select("pair.*").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _crossing(rows: DataFrame, roots: DataFrame, similar: Similarity) -> DataFrame:
    """Pairs that share a key, lie in different components and may still link; ``rows`` are the split keys.

    Two sets that meet under pairs of frequent tokens only share no rare token.
    If both were compared with one hub, they share inside it no more than either
    shares with it, and outside it no more than either has frequent tokens there:
    who failed against the hub rarely can link to the hub's other near copies.
    Such sets are paired by hub, once, and not again under each of their keys.
    Only those are paired whose sizes lie in the same or neighbouring bands: of
    sets that link, the smaller has ``percent`` of the larger's size at least.
    """
    few = rows.filter("root <> main").select(
        "key", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("size", "most", "root", "hub")]
    )
    by_key = (
        few.join(rows, "key")
        .filter("root <> a_root and (root = main or a < node)")
        .filter("not (a_hub <=> node) and not (hub <=> a)")  # compared already
        .filter("not (most < 0 and coalesce(hub = a_hub, false))")  # paired by hub
        .filter(_fits("a_", "", similar))
    )
    hub_roots = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    around = (
        rows.filter("most < 0 and hub is not null")
        .select("node", "size", "root", "hub", "inside", "outside")
        .distinct()
        .join(hub_roots, "hub", "left")
        .withColumn("main", F.coalesce("hub_root", "hub"))
        .drop("hub_root")
    )
    # The most it can share with any other there must do for a set that is as small as may be.
    around = around.filter(100 * (F.col("inside") + F.col("outside")) >= similar.percent * F.col("size"))
    # A little wider than the ratio, so that rounding parts no pair by two bands.
    width = math.log(100 / similar.percent) + 1e-6
    around = kept(around.withColumn("band", F.floor(F.log("size") / F.lit(width))), "around-hubs")
    outer = around.filter("root <> main").select(
        "hub", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("size", "root", "inside", "outside")],
        F.explode(F.array(*[F.col("band") + step for step in (-1, 0, 1)])).alias("band"),
    )
    shared = F.least("inside", "a_inside") + F.least("outside", "a_outside")
    by_hub = (
        outer.join(around, ["hub", "band"])
        .filter("root <> a_root and (root = main or a < node)")
        .filter(_enough(shared, F.col("size") + F.col("a_size"), similar))
    )
    pair = [F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")]
    return by_key.select(*pair).union(by_hub.select(*pair)).distinct()


def join_components(
    docs: DataFrame, similar: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, id, n_shingles, component_id, first, body`` of every row of ``docs``.

    Links join documents whose shingle sets reach the similarity, exactly; a text
    with fewer words than a shingle is one shingle; one without words links with
    nothing.  ``component_id`` is the least doc_id reachable by links, and
    ``first`` marks the rows of one id in each component.  Rows of one id count
    as one document.  Null text is empty; null ids are told apart by their text
    and give no component id.  An empty table gives no rows.
    """
    source = identified(docs, id_col, text_col)
    is_frequent = frequency_test(docs.sparkSession, *frequent_tokens(source, similar.width))
    rows = described(source, is_frequent, similar).withColumn("row", F.monotonically_increasing_id())
    rows = kept(rows, "described")
    count = rows.count()
    by_set = rows.filter("size > 0").groupBy("s1", "s2")
    spoken = F.min(F.struct("id", "row")).alias("spoken")
    nodes = by_set.agg(spoken, F.min(F.when(F.col("named"), F.col("id"))).alias("real"))
    nodes = nodes.select("s1", "s2", F.col("spoken.id").alias("node"), F.col("spoken.row").alias("row"), "real")
    nodes = kept(nodes, "nodes", count)

    met = kept(_meetings(rows, nodes), "meetings")
    stars = _compared(kept(_stars(met, similar), "stars", count), source, similar, is_frequent)
    done = _ordered(stars)
    roots = components(stars.filter("links").select("a", "b"))
    split, before, turn = _split_keys(met, stars, roots, similar), math.inf, 0
    while True:
        left, documents = _pairs_left(split)
        if left <= ROUND_PAIRS * documents or left > ROUND_GAIN * before:
            break
        proposals = kept(_proposals(split, done, similar, turn), "proposals", documents)
        tried = _compared(proposals, source, similar, is_frequent)
        done = done.union(tried.select("a", "b"))
        roots = components(roots.union(tried.filter("links").select("a", "b")))
        split, before, turn = _split_keys(met, stars, roots, similar), left, turn + 1
    crossing = _crossing(split, roots, similar).join(done, ["a", "b"], "left_anti") if turn else _crossing(split, roots, similar)
    across = _compared(kept(crossing, "crossing"), source, similar, is_frequent)
    roots = components(roots.union(across.filter("links").select("a", "b")))

    rooted = nodes.drop("row").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("real").alias("component_id"), F.min("node").alias("least_node"))
    placed = kept(rooted.join(least, "root").select("s1", "s2", "component_id", "least_node"), "components", count)
    own = F.when(F.col("named"), F.col("id"))
    empty = rows.filter("size = 0").select(
        own.alias("doc_id"), "id", "size", own.alias("component_id"), F.lit(True).alias("first"), "body"
    )
    full = rows.filter("size > 0").join(placed, ["s1", "s2"]).select(
        own.alias("doc_id"),
        "id",
        "size",
        "component_id",
        (F.col("id") == F.coalesce("component_id", "least_node")).alias("first"),
        "body",
    )
    return full.union(empty).withColumnRenamed("size", "n_shingles")
