"""N-gram Jaccard join with a token-group matrix.

Documents are sets of hashed five-word shingles; two link when their Jaccard similarity is 0.8 or more, and linked
documents form components. The join is exact up to collisions of 64-bit hashes.

1. Equal sets collapse to one text of their smallest document. All further work is on these representatives. A text is known
   by a hash of its id and itself, and comes once, however often its row is repeated or its id is used for others.
2. Representatives with the same smallest hash, under several orders, share a bucket. Each is compared with one leader of
   its bucket, and links make families that lie within one component. A bucket of any size costs one comparison a member.
3. Representatives are partitioned into groups of similar ones: the members of a bucket, dealt to groups of about GROUP,
   and the others alone. The token-group matrix holds, for each group, the union of its members' prefix tokens: a set of
   n tokens that shares 0.8 of a union with another shares a token with it among the first n - ceil(0.8 n) + 1 of each,
   in any order common to all sets. The order puts tokens seen often within a part of the input last. Before the first
   shared token nothing is shared, so a token's place in a set bounds the size of the sets that link by it. Groups without
   a common entry within these bounds hold no link; groups of one family need none.
4. Two groups that meet are read together. The overlap of each query with the other group's token union bounds its links:
   only a group that holds 0.8 of the query's tokens is opened, and its members compared.
5. Links join families to components.

Sets are computed from texts where they are needed and never shuffled whole. Tables of ids are broadcast while their
counted size is within a bound and joined by a shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.common import bounded, saved, unused

SIZE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Orders under which the smallest hash makes a bucket.
ORDERS = 4
SALTS = [0, 0x5555AAAA0F0FC3C3, 0xA7C3D1E5B9F08642, 0xF1D2C3B4A5968778]
#: A token in so many documents of one block of BLOCK documents counts as common; at most COMMON such tokens, the most
#: frequent ones, are put last in the order. The order changes the work only, never the result.
FREQUENT, BLOCK, COMMON = 2, 10_000, 1 << 20
#: A block's tokens are counted in ranges by so many leading bits.
RANGE_BITS = 3
WORD_MEMORY = 120_000
#: Members of a group, about, and tokens of its members together; a larger set is alone with few others.
GROUP, GROUP_TOKENS = 64, 1 << 20
#: Members that meet one copy of their leader's text; a larger bucket has several copies, each with its own members.
SHARE = 512
#: Entries of a common token that are met at once; the entries of a more frequent one are dealt to blocks of so many.
MEET = 1024
#: Neighbours from which a node's edges are joined where they are read, and nodes with so many that there may be.
HOT_DEGREE, HOT_NODES = 10_000, 100_000
#: Distinct tokens that two groups are compared on at a time.
COLUMNS = 1 << 14


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The ascending distinct hashes of a text's shingles; a shorter text is one shingle; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z and splits at \x20 \x09-\x0D
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < SIZE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    out = h[: n - SIZE + 1].copy()
    for k in range(1, SIZE):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : n - SIZE + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def feasible(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def largest_partner(n: Column, i: Column) -> Column:
    """The size of the largest set that a set of n tokens can link with if the first token they share is its i-th, from 0:
    n - i tokens are left to share."""
    return F.floor(((100 + PERCENT) * (n - i) - PERCENT * n) / PERCENT)


def parts(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield batch.slice(k, size)


def profiled(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, row (its hash), n (set size), key (of the whole set) and the smallest hash under each order; and, in rows
    without a key, tokens that a block holds often, with their counts, taken by ranges of hashes to hold little at once."""
    names = ["doc_id", "row", "n", "key", "least", "token", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.array(SALTS, np.uint64)
        for block in parts(batches):
            ranges: list[list[np.ndarray]] = [[] for _ in range(1 << RANGE_BITS)]
            for part in parts(iter([block]), 512):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                n = [len(s) for s in sets]
                keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
                least = [[int((s ^ x).min().astype(np.int64)) for x in salts] if len(s) else [] for s in sets]
                tokens = np.concatenate(sets)
                first = tokens >> np.uint64(64 - RANGE_BITS)
                for k, found in enumerate(ranges):
                    found.append(tokens[first == k])
                no = pa.array(np.zeros(len(sets), np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(least, pa.list_(pa.int64())), no, no], names=names)
            while ranges:
                tokens, counts = np.unique(np.concatenate(ranges.pop()), return_counts=True)
                often = counts >= FREQUENT
                tokens, counts = tokens[often].view(np.int64), counts[often].astype(np.int64)
                m = len(tokens)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int64())), pa.array(tokens), pa.array(counts)], names=names)
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text", row_hash()).mapInArrow(run, "doc_id long, row long, n long, key string, least array<long>, token long, seen long")


def row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")


def representatives(sets: DataFrame) -> DataFrame:
    """key, rep (the hash of a row), id (its doc_id, the smallest of the key), n, least and rows (how many are equal to it)."""
    rows = sets.groupBy("key", "row").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("least").alias("least"))
    first = rows.groupBy("key").agg(F.min_by(F.struct("row", "id", "rows", "n", "least"), F.struct("id", "row")).alias("r"))
    return first.select("key", F.col("r.row").alias("rep"), "r.id", "r.n", "r.least", "r.rows")


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """doc_id (the hash of a row) and text of the rows of docs; each representative comes once. Only where rows of some are
    repeated, those are aggregated, each task's to one before they are shuffled."""
    texts = docs.where("doc_id is not null and text is not null").select(row_hash().alias("doc_id"), "text")
    repeated = reps.where("rows > 1").select(F.col("rep").alias("doc_id"))
    if repeated.isEmpty():
        return texts
    repeated = bounded(repeated)
    once = saved(texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text")), "repeated_texts")
    return texts.join(repeated, "doc_id", "left_anti").unionByName(once)

def common_tokens(profile: DataFrame, most: int = COMMON) -> np.ndarray:
    """The ascending hashes of the most common tokens, at most `most`."""
    top = profile.where("key is null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.col("seen").desc(), "token").limit(most)
    return np.sort(top.select("token").toArrow()["token"].to_numpy().view(np.uint64))


def prefixed(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id and prefix: the first tokens of its set, common ones last, else by hash; all columns but text stay."""
    others = [c for c in docs.columns if c != "text"]
    shape = docs.select(*others).withColumn("prefix", F.array().cast("array<long>")).schema
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for part in parts(batches, 512):
            at, lengths, found = part.schema.get_field_index("text"), [0], []
            for t in part.column(at).to_pylist():
                s = shingles(t)
                if len(late) and len(s):
                    place = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    is_late = late[place] == s
                    s = np.concatenate([s[~is_late], s[is_late]])
                s = s[: len(s) - -(-PERCENT * len(s) // 100) + 1] if len(s) else s
                found.append(s)
                lengths.append(lengths[-1] + len(s))
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            array = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), array], names=[*others, "prefix"])

    return docs.select(*others, "text").mapInArrow(run, shape)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link. texts: doc_id, text, each id once. One text a pair is shuffled, by b and a share
    of b's pairs: SHARE members at most, about, so that no key grows with its bucket."""
    wanted = bounded(saved(pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "wanted"))
    dealt = pairs.join(wanted, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"))
    left = texts.join(bounded(saved(dealt, "dealt_pairs")), texts["doc_id"] == F.col("a")).select("a", "b", "share", "text")
    right = texts.join(wanted, texts["doc_id"] == F.col("b")).select(F.col("b").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("_share"), F.col("text").alias("other"))
    both = left.join(right.hint("merge"), (F.col("b") == F.col("_b")) & (F.col("share") == F.col("_share"))).select("a", "b", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for part in parts(batches, 256):
            links = []
            for a, b, text, other in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if b != last:
                    last, tokens = b, shingles(other)
                if similar(shingles(text), tokens):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node that it reaches, for every node of the edges (a, b).

    Alternates between linking every node's larger neighbours and its smaller ones to the smallest, until each
    component is a star. All state is in written tables of two or three columns. The edges of nodes with very many
    neighbours meet a broadcast table of those few nodes, no shuffle. Raises an error if the rounds don't suffice.
    """
    now, before = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or state[0] == 0:
            break
        before = state
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c")), "least")
        hot = F.col("c") > max(HOT_DEGREE, 2 * state[0] // HOT_NODES)  # so at most HOT_NODES nodes are hot
        met = around.where("b > a").join(least, "a")
        if not least.where(hot).isEmpty():
            few = F.broadcast(least.where(hot).select("a", "m"))
            apart = around.where("b > a").join(few.select("a"), "a", "left_anti").join(least.where(~hot), "a")
            met = apart.select("b", "m").unionByName(around.where("b > a").join(few, "a").select("b", "m"))
        large = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large, "large")  # a > b in every row
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = saved(small.select("e.a", "e.b").where("a <> b").distinct(), "small")
    else:
        raise RuntimeError(f"components: not stable after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(reps: DataFrame, links: DataFrame) -> DataFrame:
    """reps with grp, the smallest representative that the links reach."""
    found = bounded(saved(components(links).select(F.col("node").alias("rep"), "root"), "roots"))
    return reps.join(found, "rep", "left").withColumn("grp", F.coalesce("root", "rep")).drop("root")


def buckets_of(reps: DataFrame) -> DataFrame:
    """rep, n, order and smallest hash of every representative, with its bucket's leader b (an arbitrary member), the
    leader's size m, the number c of members and the groups that they make; only of buckets with several."""
    rows = reps.select("rep", "n", F.posexplode("least").alias("o", "h"))
    lead = rows.groupBy("o", "h").agg(F.min(F.struct(F.xxhash64("rep", "o").alias("x"), "rep", "n")).alias("l"), F.count("*").alias("c"), F.sum("n").alias("tokens")).where("c > 1")
    groups = F.greatest(F.ceil(F.col("c") / GROUP), F.ceil(F.col("tokens") / GROUP_TOKENS)).cast("long")
    lead = bounded(saved(lead.select("o", "h", F.col("l.rep").alias("b"), F.col("l.n").alias("m"), "c", groups.alias("groups")), "leaders"))
    return saved(rows.join(lead, ["o", "h"]), "buckets")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets of a and of b."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    tokens, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(tokens), COLUMNS):
        width = min(COLUMNS, len(tokens) - low)
        inside = (at >= low) & (at < low + width)
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[row[inside], at[inside] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def opened(queries: list[dict], members: list[dict], sets: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Links between two groups that join families not joined before; each row has doc_id, grp and text."""
    family: dict[int, int] = {}

    def root(x: int) -> int:
        while family.get(x, x) != x:
            x = family[x]
        return x

    b = [sets[r["text"]] for r in members]
    union = np.unique(np.concatenate(b))
    # The bound: a query opens the group only if the union holds enough of its tokens.
    asking = [r for r in queries if 100 * np.isin(sets[r["text"]], union, assume_unique=True).sum() >= PERCENT * len(sets[r["text"]])]
    if not asking:
        return []
    a = [sets[r["text"]] for r in asking]
    both = overlaps(a, b)
    sizes = np.add.outer([len(x) for x in a], [len(x) for x in b])
    links = []
    for i, j in np.argwhere(100 * both >= PERCENT * (sizes - both)):
        x, y = root(asking[i]["grp"]), root(members[j]["grp"])
        if x != y:
            family[max(x, y)] = min(x, y)
            links.append((asking[i]["doc_id"], members[j]["doc_id"]))
    return links


def compared(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the documents of paired groups. met: x, y (groups; x may equal y), doc_id, grp, cell (its
    group). The documents of a pair, about twice GROUP and twice GROUP_TOKENS tokens at most, come together in one row."""
    both = texts.join(bounded(met), "doc_id").groupBy("x", "y").agg(F.collect_list(F.struct("doc_id", "grp", "cell", "text")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 16):
            links = []
            for x, y, rows in zip(*(c.to_pylist() for c in part.columns), strict=True):
                sets = {t: shingles(t) for t in {r["text"] for r in rows}}
                links += opened([r for r in rows if r["cell"] == x], [r for r in rows if r["cell"] == y], sets)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included), for each row of docs.

    Null and empty texts, and texts without words, have no shingles and no links. Texts of any length are read whole. Rows
    with the same id are classed each by its own text, repeated rows alike; rows with a null id stay alone (component null).
    An empty table gives no rows. Other columns of docs aren't read, whatever they are called.
    """
    return keyed_classes(docs).drop("key")


def keyed_classes(docs: DataFrame) -> DataFrame:
    """The columns of classes, and key of the row's set, null without words."""
    profile = saved(profiled(docs), "profile")
    sets = profile.where("key is not null")
    linked = sets.where("n > 0 and doc_id is not null")
    reps = saved(representatives(linked), "reps")
    texts = texts_of(docs, reps)

    # 2. families by leaders: first under one order, then under the others where the families still differ
    buckets = buckets_of(reps)
    pairs = buckets.where((F.col("rep") != F.col("b")) & feasible(F.col("n"), F.col("m"))).select("o", F.col("rep").alias("a"), "b")
    links = saved(verified(saved(pairs.where("o = 0").select("a", "b").distinct(), "pairs"), texts), "links")
    groups = saved(grouped(reps, links), "families")
    of = groups.select("rep", "grp")
    apart = pairs.where("o > 0").select("a", "b").distinct().join(bounded(of.toDF("a", "ga")), "a").join(bounded(of.toDF("b", "gb")), "b").where("ga <> gb").select("a", "b")
    links = saved(links.unionByName(verified(saved(apart, "apart"), texts)), "links")
    groups = saved(grouped(reps, links), "families")

    # 3. groups: a member of buckets goes to the largest one's, dealt by hash to groups of about GROUP
    largest = buckets.groupBy("rep").agg(F.max(F.struct("c", "o", "h", "groups")).alias("l"))
    dealt = largest.select("rep", F.xxhash64("l.o", "l.h", F.pmod(F.xxhash64("rep"), F.col("l.groups"))).alias("d"))
    named = saved(dealt, "dealt")
    cell = named.join(bounded(named.groupBy("d").agg(F.min("rep").alias("cell"))), "d").select("rep", "cell")
    placed = groups.join(bounded(saved(cell, "cells")), "rep", "left").select(F.col("rep").alias("doc_id"), "grp", "n", F.coalesce("cell", "rep").alias("cell"))
    placed = bounded(saved(placed, "placed"))
    posts = saved(prefixed(texts.join(placed, "doc_id"), common_tokens(profile)), "posts")
    spread = posts.select(F.explode("prefix").alias("token"), "cell").groupBy("token").agg(F.min("cell").alias("first"), F.max("cell").alias("last"), F.ceil(F.count("*") / MEET).cast("int").alias("blocks")).where("first < last").select("token", "blocks")
    rows = posts.select("doc_id", "grp", "n", "cell", F.posexplode("prefix").alias("i", "token")).join(bounded(saved(spread, "spread")), "token")
    rows = rows.withColumn("most", largest_partner(F.col("n"), F.col("i")))
    matrix = rows.groupBy("token", "cell").agg(F.min("n").alias("low"), F.max("most").alias("most"), F.min("grp").alias("first"), F.max("grp").alias("last"), F.first("blocks").alias("blocks"), F.collect_list(F.struct("doc_id", "n", "most")).alias("docs"))
    matrix = saved(matrix, "matrix")
    # A frequent token's cells are dealt to blocks on one side and come to every block on the other: no key owns its square.
    other = matrix.select("token", *(F.col(c).alias(f"y_{c}") for c in ("cell", "low", "most", "first", "last", "docs")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    matrix = matrix.withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int")).drop("blocks")
    fits = (F.col("low") <= F.col("y_most")) & (F.col("y_low") <= F.col("most"))
    one = (F.col("first") == F.col("last")) & (F.col("y_first") == F.col("y_last")) & (F.col("first") == F.col("y_first"))
    pairs = matrix.join(other, ["token", "block"]).where((F.col("cell") < F.col("y_cell")) & fits & ~one)
    asking = F.filter("docs", lambda d: (d["n"] <= F.col("y_most")) & (d["most"] >= F.col("y_low")))["doc_id"]
    asked = F.filter("y_docs", lambda d: (d["n"] <= F.col("most")) & (d["most"] >= F.col("low")))["doc_id"]
    pairs = pairs.select(F.col("cell").alias("x"), F.col("y_cell").alias("y"), asking.alias("docs"), asked.alias("y_docs")).where("size(docs) > 0 and size(y_docs) > 0")
    pairs = pairs.groupBy("x", "y").agg(F.array_distinct(F.flatten(F.collect_set(F.concat("docs", "y_docs")))).alias("docs"))

    # 4. groups that meet, with the documents that do, and each group in itself where it has several families
    alone = placed.groupBy("cell").agg(F.min("grp").alias("first"), F.max("grp").alias("last"), F.collect_set("doc_id").alias("docs")).where("first < last").select(F.col("cell").alias("x"), F.col("cell").alias("y"), "docs")
    met = pairs.unionByName(alone).withColumn("doc_id", F.explode("docs")).drop("docs").join(placed.drop("n"), "doc_id")
    links = saved(links.unionByName(compared(saved(met, "met"), texts)), "links")

    # 5. components of all links, named by their smallest id
    found = saved(components(links), "roots")
    of = found.join(reps.select(F.col("rep").alias("node"), "id"), "node")
    smallest = saved(of.groupBy("root").agg(F.min("id").alias("component_id")), "smallest")
    named = saved(found.join(bounded(smallest), "root").select(F.col("node").alias("rep"), "component_id"), "named")
    final = reps.join(bounded(named), "rep", "left").select("key", F.coalesce("component_id", "id").alias("component_id"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key")).join(final, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "key")


def with_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with the key of each row's set, empty without words."""
    shape = docs.withColumn(name, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 512):
            sets = [shingles(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            keys = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else "" for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, name])

    return docs.mapInArrow(run, shape)


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns; documents without words all stay.

    Rows with a null id are documents of their own and all stay. Of several rows with one surviving id one stays: of those
    whose text belongs to the id's own component the one with the longest text, ties broken by a hash of the row. Only the
    rows of such ids are aggregated (each task keeps one row an id before the shuffle); all others stay where they are read.
    Null and empty texts have no words and stay; texts of any length are read whole; an empty table gives no rows; all
    columns stay, whatever they are called.
    """
    key, row = unused(docs, "_key"), unused(docs, "_row")
    found = saved(keyed_classes(docs).withColumn("own", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "classes")
    kept = saved(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("own").alias("own")).where("own").select("doc_id", "rows"), "survivors")
    out = docs.join(bounded(kept.where("doc_id is not null and rows = 1").select("doc_id")), "doc_id", "left_semi").select(*docs.columns)
    if not kept.where("doc_id is null").isEmpty():
        out = out.unionByName(docs.where("doc_id is null"))
    several = kept.where("doc_id is not null and rows > 1").select("doc_id")
    if several.isEmpty():
        return out
    several = bounded(several)
    own = found.where("own").join(several, "doc_id", "left_semi").select("doc_id", F.coalesce("key", F.lit("")).alias(key)).distinct()
    rows = with_key(docs.join(several, "doc_id", "left_semi").select(*docs.columns), key).join(bounded(saved(own, "own")), ["doc_id", key], "left_semi")
    first = F.max_by(F.struct(*docs.columns), F.struct(F.coalesce(F.length("text"), F.lit(-1)), F.xxhash64(*docs.columns)))
    return out.unionByName(rows.groupBy("doc_id").agg(first.alias(row)).select(f"{row}.*"))
