"""MinHash near-duplicates: a chosen-path set similarity join.

A document's set is its distinct 5-word shingles (64-bit hashes); its sketch is 128 minwise tokens of
that set, 64 of which trees branch by. Equal sets are folded into one representative first. Then independent trees branch the
representatives: a node chooses one sketch position, and with probability 1/3 a second one; each leads
to the child named by the token found there, so sets of similarity s stay together along a branch with
probability s, and at s = 0.75 one shared child is expected of each shared node. From START levels on,
in each node

1. all sets are compared with one of them (a star); the links join sets into components;
2. small nodes are compared exhaustively, but for pairs already in one component;
3. so are larger ones with at most OUTSIDE sets outside the node's largest component: these against all;
4. other nodes branch on, two positions each, and start again one level deeper. What still isn't done
   after MAX_DEPTH levels is dealt to blocks, each two of which are compared as one small node, so that no
   node is given up and none becomes one task.

Steps 1 and 3 are linear in a node's sets and step 2 has small nodes only: a large group of near copies
is joined by its star and done. A pair passes first by its sketches (so loosely that a true link fails
with probability below 1e-6), in small nodes also by the smallest LOWEST elements of both sets, which
for most documents are all, and then by its full sets. So what tasks emit is links and a few pairs next
to the threshold, also where thousands of sets are almost similar enough. A tree keeps a pair of similarity 0.75 together for
four levels with probability 0.53; TREES independent trees all part it with probability below 1e-6.

A set that thousands of pairs name, as a star's lead, is joined in shares: pairs are dealt to its shares by their
other set, and it is sent once for each share.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with
nothing; a text of fewer words than a shingle is one shingle; repeated rows are copies; rows that
share an id are one document, which is linked by what any of its texts is linked by; a row without an id is linked
with nothing, has no component and isn't kept. representatives() looks at texts, not at ids: of rows that
share an id, each text that has no near-copy stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import ASCII_LOWER, WordHashes, arrow_mapped, dropped, mixed, table, turned, window_hashes, written
from .subset import measured_of

WIDTH = 5
PERCENT = 75
#: Minwise tokens drawn of a set, and how many of them trees branch by.
TOKENS = 128
POSITIONS = 64
TREES = 20
START = 4
MAX_DEPTH = 24
OUTSIDE = 16
SMALL = 2048
#: Rows of small nodes that one task compares.
BATCH_ROWS = 20_000
#: Pairs that one share of a set is joined with, and the most sets in shares: a broadcast of 16 MB.
HOT, MAX_HOT = 4096, 1 << 20
#: Of 128 tokens that agree with probability 0.75 each, fewer agree with probability below 1e-6.
AGREE = 71
#: The smallest elements of a set that small nodes compare: sets of no more elements are compared whole.
LOWEST = 512
CHUNK = 8192
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = known.of((text or "").encode().translate(ASCII_LOWER).split())
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))


def _multipliers(positions: int) -> np.ndarray:
    return mixed(np.arange(1, positions + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def sketch(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The upper half of the smallest product of an element and each factor, modulo 2^64."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), CHUNK):
        least = np.minimum(least, (factors[:, None] * found[None, i : i + CHUNK]).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, set_key (128 bits of the set; null if empty), sketch (the tokens to branch by) and code (a byte of each token)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known, factors = WordHashes(), _multipliers(TOKENS)
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                found = shingles(text, width, known)
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                drawn = sketch(found, factors)
                rows.append((len(found), set_key(found), drawn[:POSITIONS].tobytes(), drawn.astype("u1").tobytes()))
            yield [batch["doc_id"], batch["hash"], *turned(rows, 4)]

    schema = "doc_id long, hash long, n_shingles long, set_key binary, sketch binary, code binary"
    return arrow_mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), measure, schema)


def _children(keys: np.ndarray, tokens: np.ndarray, rows: np.ndarray, sparse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of the children. keys: of the nodes; rows: for each, which of the sketches in tokens; sparse: a third of the nodes have a second child, else all."""
    positions = np.uint64(tokens.shape[1])
    chosen = mixed(keys ^ np.uint64(0xA5A5A5A5))
    a = chosen % positions
    b = (a + np.uint64(1) + (chosen >> np.uint64(32)) % (positions - np.uint64(1))) % positions
    second = (chosen >> np.uint64(20)) % np.uint64(3) == 0 if sparse else np.ones(len(keys), bool)
    keys, rows, p = np.concatenate([keys, keys[second]]), np.concatenate([rows, rows[second]]), np.concatenate([a, b[second]])
    with np.errstate(over="ignore"):
        return mixed(keys * _STEP + (p << np.uint64(32)) + tokens[rows, p.astype(np.int64)]), rows


def _bytes(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _planted(reps: DataFrame, trees: int, depth: int) -> DataFrame:
    """key and rep of the nodes at depth of all trees."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            tokens, ids = _bytes(batch["sketch"], "<u4").astype(np.uint64), batch["rep"].to_numpy()
            for tree in range(trees):
                root = mixed(np.array([tree + 1], np.uint64))[0]
                keys, rows = np.full(len(batch), root, np.uint64), np.arange(len(batch))
                for _ in range(depth):
                    keys, rows = _children(keys, tokens, rows, sparse=True)
                yield pd.DataFrame({"key": keys.astype(np.int64), "rep": ids[rows]})

    return reps.select("rep", "sketch").mapInPandas(grow, "key long, rep long")


def _branched(nodes: DataFrame) -> DataFrame:
    """nodes: key, rep, sketch. key and rep one level deeper."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                tokens = _bytes(batch["sketch"], "<u4").astype(np.uint64)
                keys, rows = _children(batch["key"].to_numpy().astype(np.uint64), tokens, np.arange(len(batch)), sparse=False)
                yield pd.DataFrame({"key": keys.astype(np.int64), "rep": batch["rep"].to_numpy()[rows]})

    return nodes.select("key", "rep", "sketch").mapInPandas(grow, "key long, rep long")


def _hot(counts: DataFrame) -> DataFrame | None:
    """counts: id, n. The ids named by over HOT pairs, with the shares that each is joined in; None if there are none, or so many that they
    spread by themselves."""
    hot = written(counts.where(F.col("n") > HOT).select("id", F.ceil(F.col("n") / HOT).cast("int").alias("shares")), "hot")
    return hot if 0 < hot.count() <= MAX_HOT else None


def _joined(pairs: DataFrame, values: DataFrame, hot: DataFrame | None) -> DataFrame:
    """pairs: a, b; values: id and one column. Adds that of a as x and that of b as y. Only a may be hot."""
    pairs = pairs.join(values.toDF("b", "y"), "b")
    if hot is None:
        return pairs.join(values.toDF("a", "x"), "a")
    shares = F.coalesce("shares", F.lit(1))
    dealt = pairs.join(F.broadcast(hot.toDF("a", "shares")), "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), shares).cast("int")).drop("shares")
    copies = values.join(F.broadcast(hot), "id", "left")
    copies = copies.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    return dealt.join(copies.toDF("a", "x", "share"), ["a", "share"])


def _sided(pairs: DataFrame, hot: DataFrame | None) -> DataFrame:
    """pairs with the id of more shares as a."""
    if hot is None:
        return pairs
    both = pairs.join(F.broadcast(hot.toDF("a", "_a")), "a", "left").join(F.broadcast(hot.toDF("b", "_b")), "b", "left")
    swap = F.coalesce("_b", F.lit(0)) > F.coalesce("_a", F.lit(0))
    return both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    """id and n, the pairs that name it."""
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))


def _near(pairs: DataFrame, hot: DataFrame | None, reps: DataFrame, agree: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree in enough positions."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                same = (_bytes(batch["x"], "u1") == _bytes(batch["y"], "u1")).sum(axis=1)
                yield batch.loc[same >= agree, ["a", "b"]]

    both = _joined(pairs, reps.select(F.col("rep").alias("id"), "code"), hot)
    return both.select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")


def _may_link(one: np.ndarray, others: list[np.ndarray], whole: np.ndarray, percent: int) -> np.ndarray:
    """Which of others may be similar to one. All are the smallest elements of sets, sorted; whole: pairs of which both are all of the set.

    Below the smaller of the two largest elements both are complete, so what lies there is a sample of
    the union: the share found in both estimates the similarity. Five standard deviations are allowed
    for, and one percent for whole sets, whose elements are cut to 32 bits.
    """
    ends = np.cumsum([len(x) for x in others])
    starts = np.concatenate([[0], ends[:-1]])
    every = np.concatenate(others)
    most = np.where(whole, np.uint32(0xFFFFFFFF), np.minimum(every[ends - 1], one[-1]))
    inside = every <= np.repeat(most, ends - starts)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    shared = np.add.reduceat((one[at] == every) & inside, starts, dtype=np.int64)
    union = np.add.reduceat(inside, starts, dtype=np.int64) + np.searchsorted(one, most, side="right") - shared
    share = percent / 100
    slack = np.where(whole, 0.01, 5 * np.sqrt(share * (1 - share) / np.maximum(union, 1)))
    return shared >= (share - slack) * union


def _near_in_nodes(nodes: DataFrame, tasks: int, agree: int, percent: int) -> DataFrame:
    """nodes: key, rep, label, n_shingles, code, lowest, of small nodes. Pairs of unlike labels that may be similar."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        keys, ids, labels = (rows[c].to_numpy() for c in ("key", "rep", "label"))
        codes, lowest = _bytes(rows["code"], "u1"), [np.frombuffer(x, "<u4") for x in rows["lowest"]]
        whole = rows["n_shingles"].to_numpy() <= LOWEST
        ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
        found, start = set(), 0
        for end in ends:
            x, own = codes[start:end], labels[start:end]
            names, sizes = np.unique(own, return_counts=True)
            for i in np.flatnonzero(own != names[sizes.argmax()]):
                near = start + np.flatnonzero(((x == x[i]).sum(axis=1) >= agree) & (own != own[i]))
                if len(near):
                    near = near[_may_link(lowest[start + i], [lowest[j] for j in near], whole[near] & whole[start + i], percent)]
                p = int(ids[start + i])
                found.update((p, q) if p < q else (q, p) for q in ids[near].tolist())
            start = end
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype=np.int64)

    part = F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("part")
    return nodes.select(part, "key", "rep", "label", "n_shingles", "code", "lowest").groupBy("part").applyInPandas(compare, "a long, b long")


def _of_sets(docs: DataFrame, reps: DataFrame, ids: DataFrame, width: int, value, schema: str) -> DataFrame:
    """id and value(the set) of the representatives in ids, measured on a document that has the set."""
    wanted = written(reps.join(ids.withColumnRenamed("id", "rep"), "rep", "left_semi").select("rep", "set_key", F.col("doc").alias("id")), "wanted")

    def measure(batch: pd.DataFrame) -> pd.DataFrame:
        known, rows = WordHashes(), {}
        for text in batch["text"]:
            found = shingles(text, width, known)
            if len(found) and (key := set_key(found)) not in rows:
                rows[key] = value(found)
        return pd.DataFrame({"set_key": list(rows), "value": list(rows.values())})

    found = measured_of(docs, wanted, measure, f"set_key binary, value {schema}").groupBy("set_key").agg(F.first("value").alias("value"))
    return found.join(wanted, "set_key").select(F.col("rep").alias("id"), "value")


def _lowest(found: np.ndarray) -> bytes:
    """The upper halves of a set's smallest elements."""
    return (found[:LOWEST] >> np.uint64(32)).astype("<u4").tobytes()


def confirm(near: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """near: pairs (a, b), a written table. Those whose full sets are similar enough."""
    counts = written(_ends(near), "ids")
    full = written(_of_sets(docs, reps, counts.select("id"), width, lambda x: x.astype(np.int64), "array<long>"), "sets")
    hot = _hot(counts)
    near = _sided(near, hot)
    shared = F.size(F.array_intersect("x", "y"))
    both = _joined(near, full, hot).where(100 * shared >= percent * (F.size("x") + F.size("y") - shared))
    out = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "confirmed")
    dropped(counts, full)
    return out


class _Links:
    """Tested pairs, confirmed links and the components they make, so far."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, percent: int):
        self.docs, self.reps, self.width, self.percent = docs, reps, width, percent
        self.tested = None
        self.found = docs.sparkSession.createDataFrame([], "a long, b long")
        self.labels = docs.sparkSession.createDataFrame([], "id long, component long")

    def add(self, near: DataFrame) -> None:
        near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if self.tested is not None:
            near = near.join(self.tested, ["a", "b"], "left_anti")
        near = written(near, "near")
        if near.isEmpty():
            return
        self.tested = near if self.tested is None else self.tested.unionByName(near)
        new = confirm(near, self.docs, self.reps, self.width, self.percent)
        if not new.isEmpty():
            self.found = self.found.unionByName(new)
            self.labels = written(components(self.found), "labels")


def _across(nodes: DataFrame) -> DataFrame:
    """Pairs of what lies outside a node's main component with all of other components."""
    others = nodes.where("label <> main").select("key", F.col("rep").alias("a"), F.col("label").alias("x"))
    return others.join(nodes.select("key", F.col("rep").alias("b"), "label"), "key").where("x <> label").select("a", "b").distinct()


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Large nodes as small ones: each set is in the blocks that pair its own with every other of its node."""
    n = F.ceil(F.col("all") / SMALL).cast("int")
    own = nodes.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    each = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    key = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return each.withColumn("key", key).select(nodes.columns)


def linked(docs: DataFrame, reps: DataFrame, width: int, percent: int, trees: int, start: int = START, agree: int = AGREE) -> _Links:
    """The links of representatives (reps: rep, doc, set_key, n_shingles, sketch, code) and their components."""
    links = _Links(docs, reps, width, percent)
    rows = written(_planted(reps, trees, start), "nodes")
    for depth in range(start, MAX_DEPTH + 1):
        # the lead, whose id differs least from the key, is another set in other nodes
        least = F.min(F.col("rep").bitwiseXOR(F.col("key"))).bitwiseXOR(F.col("key"))
        shared = written(rows.groupBy("key").agg(F.count("*").alias("n"), least.alias("lead")).where("n > 1"), "leads")
        nodes = written(rows.join(shared.select("key", "lead"), "key").select("key", "rep", "lead"), "shared-nodes")
        dropped(rows)
        star = nodes.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
        links.add(_near(star, _hot(shared.groupBy(F.col("lead").alias("id")).agg(F.sum("n").alias("n"))), reps, agree))
        named = nodes.join(links.labels.withColumnRenamed("id", "rep"), "rep", "left").select(
            "key", "rep", F.coalesce("component", "rep").alias("label")
        )
        counts = named.groupBy("key", "label").agg(F.count("*").alias("n"))
        several = counts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).select(
            "key", "all", F.col("top.label").alias("main"), (F.col("all") - F.col("top.n")).alias("out")
        ).where("out > 0")
        undone = written(named.join(several, "key"), "undone-nodes")
        small, large = undone.where(F.col("all") <= SMALL), undone.where(F.col("all") > SMALL)
        few, many = large.where(F.col("out") <= OUTSIDE), large.where(F.col("out") > OUTSIDE)
        if depth == MAX_DEPTH:
            small = small.unionByName(_in_blocks(many))
        if n := small.count():
            ids = written(small.select(F.col("rep").alias("id")).distinct(), "ids")
            lowest = written(_of_sets(docs, reps, ids, width, _lowest, "binary").toDF("rep", "lowest"), "lowest")
            described = small.join(reps.select("rep", "n_shingles", "code"), "rep").join(lowest, "rep")
            links.add(_near_in_nodes(described, -(-n // BATCH_ROWS) + 11, agree, percent))
            dropped(ids, lowest)
        if not few.isEmpty():
            outside = few.where("label <> main").groupBy(F.col("rep").alias("id")).agg(F.sum("all").alias("n"))
            links.add(_near(_across(few), _hot(outside), reps, agree))
        done = depth == MAX_DEPTH or many.isEmpty()
        if not done:
            rows = written(_branched(many.select("key", "rep").join(reps.select("rep", "sketch"), "rep")), "nodes")
        dropped(nodes, shared, undone)
        if done:
            break
    return links


def _drawn(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows; one representative, numbered, of each set; the ids of several rows with their number, least and greatest set."""
    drawn = written(sketches(docs, width), "sketches")
    named = drawn.where("doc_id is not null")
    first = named.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("n_shingles", "sketch", "code")))
    reps = written(first.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    several = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("n > 1")
    return drawn, reps, written(several, "several")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    drawn, reps, several = _drawn(docs, width)
    labels = linked(docs, reps, width, percent, trees).labels.where("id <> component")
    # one pair for each set and its component, by their documents; a large component is joined in shares
    hot = _hot(labels.groupBy(F.col("component").alias("id")).agg(F.count("*").alias("n")))
    pairs = _joined(labels.toDF("b", "a"), reps.select(F.col("rep").alias("id"), "doc"), hot).select(F.col("x").alias("a"), F.col("y").alias("b"))
    keyed = drawn.select("doc_id", "n_shingles", "set_key")
    if not several.isEmpty():  # an id is linked with the documents its texts stand for, and its empty texts go where its others are
        other = drawn.join(several.where("low <> high").select("doc_id"), "doc_id", "left_semi").join(reps.select("set_key", "doc"), "set_key")
        pairs = pairs.unionByName(other.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct())
        keyed = keyed.join(several.select("doc_id", "low"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("set_key", "low").alias("set_key"))
    labels = written(components(pairs), "labels").withColumnRenamed("id", "doc")
    found = reps.select("set_key", "doc").join(labels, "doc", "left").select("set_key", F.coalesce("component", "doc").alias("found"))
    out = keyed.join(found, "set_key", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """One row of docs for each group of near-copies among its texts; rows without an id stay."""
    drawn, reps, several = _drawn(docs.select("doc_id", "text"), width)
    labels = linked(docs.select("doc_id", "text"), reps, width, percent, trees).labels.withColumnRenamed("id", "rep")
    group = reps.join(labels, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("group"))
    named = drawn.where("doc_id is not null").select(F.col("doc_id").alias("id"), "hash", "set_key")
    first = named.join(group, "set_key").groupBy("group").agg(F.min(F.struct("id", "hash")).alias("first")).select("first.id", "first.hash")
    kept = first.unionByName(named.where("set_key is null").select("id", "hash").distinct())
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("doc")
    chosen = docs.select(whole, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).join(kept, ["id", "hash"], "left_semi")
    if not several.isEmpty():
        chosen = chosen.dropDuplicates(["id", "hash"])
    return chosen.select("doc.*").unionByName(docs.where("doc_id is null"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The exact join for DuckDB: all pairs that share a shingle, and what they reach.
NEAR_DUPLICATES_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) end) as s from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from n union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as component_id from r group by 1)
select doc_id, cast(n as bigint) as n_shingles, component_id, doc_id = component_id as kept from n join m on a = doc_id
"""
