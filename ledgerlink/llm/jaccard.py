"""Near-duplicate documents: a Jaccard join over sets of five-word shingles, by R-trees of count vectors.

Texts with the same set form a class, known by a hash of the set; only classes are compared. The
tokens of a set are its shingles, by 64-bit hash, in one order for all sets: those found often last.
Two sets with a similarity of 0.8 have k of the first 0.2 n + k tokens of either (its prefix) in
common, for any k; k grows with n here, and classes with fewer prefix tokens that any other class has
are out. All links lie within groups of classes that share a prefix token. A group is searched with
an R-tree of count vectors (see ``rtree``); surviving pairs are verified on the sets.

In a large group of near copies every pair would survive, but components need no more than a spanning
set of links. So where a group has far more surviving pairs than classes, only some spanning forests of
them are verified, those of the highest bounds first. The group is searched again, with more forests
and in the end all pairs, as long as its classes lie in different components; only pairs between
components are looked at then. Groups of more than BLOCK classes are first searched in blocks drawn
anew for each round; what then still lies in different components is compared block by block with
each other block. No link between components is missed: two linked classes share a prefix token, and the
last round of its group compares them unless they are already connected.

Passes over the text emit one row per document, tokens added up in each task, and the sets of those
classes that share a prefix token with another one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, col, fresh, small_batches, steps, table, tasks, written
from .components import components
from .rtree import Tree, enough
from .words import grams, mixed, split, word_hashes

SHINGLE = 5
#: Groups that tokens are hashed into for the tree, and at most for the bound of a pair: a set has
#: about half as many fine groups as tokens.
GROUPS, FINE_GROUPS = 64, 1 << 15
#: Frequent tokens that all tasks know; a bound of what is broadcast, not of what is compared.
FREQUENT = 1 << 16
#: Tokens that a task has seen so often, about, may be frequent.
OFTEN = 8
#: Classes of a group that one step compares.
BLOCK = 2048
#: Groups that a class names to tell where a pair was seen.
HEAD = 8
#: Spanning forests that a group with many surviving pairs yields in each round; all pairs in the last.
#: In the first round, a class is only in its largest group.
FORESTS = (1, 1, 8, 64, None)


class Sets:
    """Distinct shingles of some texts: by text, then by hash."""

    def __init__(self, texts: list[str]):
        w = split(texts, lower=True)
        hashes = word_hashes(w)
        many = max(0, len(hashes) - SHINGLE + 1)
        whole = w.doc[:many] == w.doc[SHINGLE - 1 :] if many else np.zeros(0, bool)
        token, doc = grams(hashes, SHINGLE)[whole], w.doc[:many][whole]
        n = np.diff(w.first)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        if len(short):
            # The whole sequence is the only shingle.
            own = np.array([mixed(grams(hashes[w.first[i] : w.first[i + 1]], int(n[i])) + np.uint64(n[i]))[0] for i in short], np.uint64)
            token, doc = np.concatenate([token, own]), np.concatenate([doc, short])
        by = np.argsort(token)
        by = by[stable_order(doc[by])]
        token, doc = token[by], doc[by]
        new = np.ones(len(by), bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        self.token, self.doc = token[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)

    def keys(self) -> np.ndarray:
        """A hash of each set; 0 for an empty one."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.token ^ np.uint64(0x5851F42D4C957F2D)))])
        summed = total[self.first[1:]] - total[self.first[:-1]]
        return np.where(self.size > 0, np.maximum(mixed(summed + self.size.astype(np.uint64)), np.uint64(1)), np.uint64(0))

    def prefixes(self, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which tokens are among the first n - ceil(0.8 n) + shared_at_least(n) of their sets."""
        values, counts = frequent
        often = np.zeros(len(self.token), bool)
        if len(values):
            at = np.minimum(np.searchsorted(values, self.token), len(values) - 1)
            often = values[at] == self.token
        # Rare tokens are in order; each frequent one comes after them, by its count.
        rare_before = np.concatenate([[0], np.cumsum(~often)])
        nth = rare_before[:-1] - rare_before[self.first[self.doc]]
        late = np.flatnonzero(often)
        if len(late):
            by = late[np.lexsort((self.token[late], counts[at[late]], self.doc[late]))]
            doc = self.doc[by]
            place = np.arange(len(by))
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            rares = rare_before[self.first[1:]] - rare_before[self.first[:-1]]
            nth[by] = rares[doc] + place - np.repeat(begin, np.diff(np.append(begin, len(by))))
        size = self.size[self.doc]
        return nth < size - -(-4 * size // 5) + shared_at_least(size)


def shared_at_least(n):
    """Prefix tokens that a set of n tokens or more has in common with any similar one."""
    return 1 + n // 40


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable ascending order of small numbers (a radix sort where they have 16 bits)."""
    small = not len(values) or values.max() < 1 << 16
    return np.argsort(values.astype(np.uint16) if small else values, kind="stable")


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def describe(docs: DataFrame) -> DataFrame:
    """One row per document (kind 0: id, size and key of its set) and per token that is frequent in a task (kind 1: token, count).

    A task counts its tokens by 22 bits of their hash, and those whose cell has reached OFTEN by
    themselves. The counts only order the tokens; no result depends on them.
    """

    def run(batches):
        cells = np.zeros(1 << 22, np.int32)
        held: list[np.ndarray] = []
        size = 0

        def rows(kind, a, b, c):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, b, c], names=["kind", "a", "n", "key"])

        def often():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return rows(1, long_array(values), pa.array(n), long_array(values))

        for batch in batches:
            at = 0
            for part in steps(batch.column(1)):
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                s = Sets(part)
                yield rows(0, ids, pa.array(s.size), long_array(s.keys()))
                cell = (s.token >> np.uint64(42)).astype(np.int64)
                np.add.at(cells, cell, 1)
                held.append(s.token[cells[cell] >= OFTEN])
                size += len(held[-1])
                if size > 1_000_000:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, a long, n long, key long")


def frequent_tokens(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent tokens with their counts, by token."""
    top = found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "a").limit(FREQUENT).toArrow()
    values, n = top["a"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by = np.argsort(values)
    return values[by], n[by]


def prefix_tokens(docs: DataFrame, frequent) -> DataFrame:
    """Prefix tokens with the key of their set: (token, key)."""

    def run(batches):
        for batch in batches:
            for part in steps(batch.column(0)):
                s = Sets(part)
                chosen = s.prefixes(frequent.value)
                yield pa.RecordBatch.from_arrays([long_array(s.token[chosen]), long_array(s.keys()[s.doc[chosen]])], names=["token", "key"])

    return docs.select("text").mapInArrow(run, "token long, key long")


POINT = "key long, n long, counts binary, tokens array<long>, shingles binary"


def count_type(n: int) -> type:
    return np.uint8 if n < 1 << 8 else np.uint16 if n < 1 << 16 else np.uint32


def fine_counts(token: np.ndarray) -> np.ndarray:
    """Tokens in each fine group; groups of any coarser division are runs of these."""
    bits = min(FINE_GROUPS.bit_length() - 1, max(GROUPS.bit_length() - 1, (len(token) // 2).bit_length()))
    count = np.bincount((mixed(token) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(count_type(len(token)))


def counts_of(blob: bytes, n: int) -> np.ndarray:
    """Fine counts of a set of n tokens, as written."""
    return np.frombuffer(zlib.decompress(blob), count_type(n))


def packed(token: np.ndarray) -> bytes:
    """Sorted tokens, all 64 bits of them."""
    return token.astype("<u8").tobytes()


def tokens_of(blob) -> np.ndarray:
    """Tokens as ``packed`` wrote them."""
    return np.frombuffer(blob, "<u8")


def fold(fine: np.ndarray, groups: int) -> np.ndarray:
    """Counts by ``groups`` groups."""
    return fine if len(fine) == groups else fine.reshape(groups, -1).sum(1, dtype=np.int64)


def common_bound(x: np.ndarray, y: np.ndarray) -> int:
    """What two sets have in common at most, by their fine counts."""
    groups = min(len(x), len(y))
    return int(np.minimum(fold(x, groups), fold(y, groups)).sum(dtype=np.int64))


def points(docs: DataFrame, frequent, known: Filter) -> DataFrame:
    """Sets with enough known prefix tokens, with their count vectors; each once per task."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            for part in steps(batch.column(0)):
                s = Sets(part)
                chosen = s.prefixes(frequent.value)
                chosen[chosen] = known.has(s.token[chosen])
                keys = s.keys()
                rows = []
                found = np.bincount(s.doc[chosen], minlength=len(part))
                # The smaller one of a similar pair has 0.8 n tokens at least.
                for i in np.flatnonzero((found > 0) & (found >= shared_at_least(-(-4 * s.size // 5)))).tolist():
                    if (key := int(keys[i])) in done:
                        continue
                    done.add(key)
                    a, b = int(s.first[i]), int(s.first[i + 1])
                    token = s.token[a:b]
                    rows.append((np.uint64(key).astype(np.int64), b - a, zlib.compress(fine_counts(token).tobytes(), 1), token[chosen[a:b]].view(np.int64), packed(token)))
                if rows:
                    key, n, counts, tokens, shingles = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key, pa.int64()),
                            pa.array(n, pa.int64()),
                            pa.array(counts, pa.binary()),
                            pa.array([t.tolist() for t in tokens], pa.list_(pa.int64())),
                            pa.array(shingles, pa.binary()),
                        ],
                        names=["key", "n", "counts", "tokens", "shingles"],
                    )

    return docs.select("text").mapInArrow(run, POINT)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of keys whose sets are similar enough; ``pairs`` is a written table.

    Only the sets in question are dealt out: those of the b's come to the tasks of their a's, and each
    task keeps the set of one a. An a with many b's has a copy for each BLOCK of them.
    """
    if not pairs.take(1):
        return pairs
    both = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    asked = Filter(both.select(F.xxhash64("a").alias("h")), "h")
    wanted = sets.select("key", "shingles").where(asked.may_have(F.xxhash64("key")))
    loads = pairs.groupBy("a").agg(F.count("*").alias("m")).select("a", F.ceil(F.col("m") / BLOCK).cast("int").alias("ways"))
    salted = pairs.join(loads, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "ways").cast("int"))
    members = salted.join(wanted, salted["b"] == wanted["key"]).select("a", "salt", F.lit(1).alias("kind"), "key", "shingles")
    centres = loads.join(wanted, loads["a"] == wanted["key"])
    centres = centres.select("a", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("salt"), F.lit(0).alias("kind"), "key", "shingles")

    def run(batches):
        held, centre = None, None
        for batch in batches:
            a, b = [], []
            for of, kind, key, blob in zip(*(batch.column(i) for i in range(4))):
                if kind.as_py() == 0:
                    held = of.as_py()
                    centre = tokens_of(blob.as_buffer())
                    continue
                if held != of.as_py():
                    raise ValueError("a set is missing")
                own = tokens_of(blob.as_buffer())
                at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                if enough((centre[at] == own).sum(), len(own), len(centre)):
                    a.append(held)
                    b.append(key.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = members.unionByName(centres).repartition(tasks(sets.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "kind")
    return rows.select("a", "kind", "key", "shingles").mapInArrow(run, "a long, b long")


def forests(a: np.ndarray, b: np.ndarray, n: int, most: int) -> np.ndarray:
    """Places of the links (a, b) between ``n`` nodes that make up ``most`` spanning forests, each of the
    first links that the forests before have left."""
    chosen: list[int] = []
    left = list(zip(range(len(a)), a.tolist(), b.tolist()))
    for _ in range(most):
        above, rest, joined = list(range(n)), [], 0
        for at, link in enumerate(left):
            x, y = link[1:]
            while above[x] != x:
                above[x] = x = above[above[x]]
            while above[y] != y:
                above[y] = y = above[above[y]]
            if x == y:
                rest.append(link)
                continue
            above[x] = y
            chosen.append(link[0])
            joined += 1
            if joined == n - 1:
                rest += left[at + 1 :]
                break
        left = rest
        if not joined:
            break
    return np.array(sorted(chosen), np.int64)


def searched(rows: DataFrame, most: int | None, whole_groups: bool = True) -> DataFrame:
    """Pairs of classes that an R-tree search leaves (a, b, a < b), and the tokens (cut) whose group has
    more.

    ``rows`` has (token, one, other, whole, block, key, root, n, counts, tokens); the classes with the
    same token, one and other are a group of one block (one = other) or a pair of blocks. ``tokens`` are
    the first groups of the class; with ``whole_groups``, a pair that shares an earlier one of them comes
    from there. A pair may come from several groups. With ``most``, a group that leaves more than that many pairs per class
    gives as many spanning forests of its components; it is cut, as is one that is not whole here.
    """

    def run(batches):
        held: list[tuple] = []
        group = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != group:
                    out += of_group(held, group)
                    held, group = [], row[:3]
                held.append(row[3:])
            if out:
                yield result(out)
        if out := of_group(held, group):
            yield result(out)

    def result(out):
        a, b, cut = (np.concatenate([p[i] for p in out]) for i in (0, 1, 2))
        is_pair = a != b
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b), mask=~is_pair), pa.array(np.maximum(a, b), mask=~is_pair), pa.array(cut, mask=is_pair)], names=["a", "b", "cut"]
        )

    def of_group(held, group):
        if len(held) < 2:
            return []
        whole, block, key, root, n, counts, tokens = zip(*held)
        block, key, root, n = (np.array(x, np.int64) for x in (block, key, root, n))
        out = []
        none = np.zeros(1, np.int64)
        if most is not None and not whole[0]:
            out.append((none, none, none + group[0]))
        fine = [counts_of(c, m) for c, m in zip(counts, n.tolist())]
        vectors = np.stack([fold(f, GROUPS) for f in fine]).astype(np.int32)
        left = np.flatnonzero(block == group[1])
        right = left if group[1] == group[2] else np.flatnonzero(block == group[2])
        if not len(left) or not len(right):
            return out
        q, p = Tree(vectors[right], n[right]).search(vectors[left], n[left])
        q, p = left[q], right[p]
        apart = (root[q] != root[p]) & ((q < p) if group[1] == group[2] else True)
        q, p = q[apart], p[apart]
        bound = np.array([common_bound(fine[i], fine[j]) for i, j in zip(q.tolist(), p.tolist())], np.int64)
        open_pair = enough(bound, n[q], n[p])
        sets = {i: frozenset(tokens[i]) for i in {*q[open_pair].tolist(), *p[open_pair].tolist()}}
        for k in np.flatnonzero(open_pair).tolist() if whole_groups else ():
            open_pair[k] = min(sets[q[k]] & sets[p[k]], default=group[0]) >= group[0]
        q, p, bound = q[open_pair], p[open_pair], bound[open_pair]
        if most is not None and len(q) > most * len(held):
            likeness = bound / (n[q] + n[p] - bound)
            by = np.lexsort((key[p], key[q], -likeness))
            q, p = q[by], p[by]
            nodes, of = np.unique(root, return_inverse=True)
            chosen = forests(of[q], of[p], len(nodes), most)
            q, p = q[chosen], p[chosen]
            out.append((none, none, none + group[0]))
        if len(q):
            out.append((key[q], key[p], np.zeros(len(q), np.int64)))
        return out

    ordered = rows.repartition(tasks(rows.sparkSession), "token", "one", "other").sortWithinPartitions("token", "one", "other", "key")
    wide = ordered.select("token", "one", "other", "whole", "block", "key", "root", "n", "counts", "tokens")
    return wide.mapInArrow(run, "a long, b long, cut long").distinct()


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Links between classes (a, b) that span every component of similar sets."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(found))
    shared = prefix_tokens(docs, frequent).groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = written(shared.where("low <> high").select("token"))
    known = Filter(shared, "token")
    if not shared.take(1):
        return spark.createDataFrame([], "a long, b long")
    # A class is in it once for each task that has a document of it.
    sets = written(points(docs, frequent, known))
    vectors = written(sets.select("key", "n", "counts", "tokens").dropDuplicates(["key"]))
    # A group is the classes of one token; tokens with the same classes are one group.
    member = written(vectors.select("key", F.explode("tokens").alias("token")).join(shared, "token", "left_semi"))
    twins = member.groupBy("token").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64(F.lit("x"), "key")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "key")).alias("y")
    )
    chosen = written(twins.where("m > 1").groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token", "m"))
    member = written(member.join(chosen, "token"))
    home = member.groupBy("key").agg(F.max_by("token", F.struct("m", "token")).alias("token"))
    # The first of its groups tell most pairs of classes in which of their groups they were seen.
    own = member.groupBy(F.col("key").alias("of")).agg(F.slice(F.sort_array(F.collect_list("token")), 1, HEAD).alias("tokens"))
    own = own.join(vectors.select("key", "n", "counts"), F.col("of") == vectors["key"]).select("of", "tokens", "n", "counts")
    own = written(own)
    found_links, roots, todo = None, None, None
    for nth, most in enumerate(FORESTS):
        placed = home if nth == 0 else member
        if todo is not None:
            placed = placed.join(todo, F.col("token") == F.col("cut"), "left_semi")
        placed = with_roots(placed, roots)
        groups = placed.groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
        groups = groups.where("low <> high").select(F.col("token").alias("chosen"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        rows = placed.join(groups, placed["token"] == groups["chosen"]).select("token", "key", "root", "blocks")
        rows = rows.join(own, rows["key"] == own["of"]).drop("of")
        rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(nth), F.col("key")), "blocks").cast("int"))
        mine = F.array(F.col("block")) if most is not None else F.sequence(F.lit(0), F.col("blocks") - 1)
        rows = rows.withColumn("with", F.explode(mine)).withColumn("whole", F.col("blocks") == 1)
        rows = rows.withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")})
        left = written(searched(rows, most, nth > 0))
        more = verified(written(left.where("cut is null").select("a", "b")), sets).distinct()
        found_links = written(more if found_links is None else found_links.unionByName(more))
        if nth > 0:
            todo = left.where("cut is not null").select("cut").distinct()
            if not todo.take(1):
                break
        roots = written(components(found_links))
    return found_links


def with_roots(member: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``member`` with the component that each class has so far."""
    if roots is None:
        return member.withColumn("root", F.col("key"))
    return member.join(roots, F.col("key") == F.col("node"), "left").select("token", "key", F.coalesce("root", "key").alias("root"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, key), and the lowest id of the component of each key: (of, component_id)."""
    small_batches()
    found = written(describe(docs), ["kind"])
    own = found.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "key")
    lowest = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    roots = components(links(docs, found))
    lowest = lowest.join(roots, F.col("key") == F.col("node"), "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    lowest = written(lowest)
    component = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    return own, lowest.join(component, "root").select(F.col("key").alias("of"), "component_id")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set and the lowest document of its component.

    A document without words has an empty set and is alone. Rows with the same id each have their
    own set and count for that id; a NULL id never is the lowest unless it is alone.
    """
    own, components_of = classes(table(spark, sf_dir, "documents"))
    out = own.join(components_of, (own["key"] == components_of["of"]) & (own["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: The same in SQL: links by common shingles, components by repeated lowest neighbours.
OP5_SQL = r"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
    from documents
), shingles as (
    select distinct doc_id, s from (
        select doc_id, array_to_string(words[p : p + 4], ' ') as s
        from (select doc_id, words, unnest(range(1, len(words) - 3)) as p from split where len(words) >= 5)
        union all
        select doc_id, array_to_string(words, ' ') from split where len(words) between 1 and 4)
), sized as (
    select doc_id, count(*) as n from shingles group by doc_id
), classes as (
    select doc_id, n, list_sort(s) as own from (select doc_id, count(*) as n, list(s) as s from shingles group by doc_id)
), lowest as (
    select doc_id, n, min(doc_id) over (partition by own) as rep from classes
), rep_shingles as (
    select s.doc_id, s.s, l.n from shingles s join lowest l on l.doc_id = s.doc_id and l.rep = s.doc_id
), links as (
    select a.doc_id as x, b.doc_id as y
    from rep_shingles a join rep_shingles b on a.s = b.s and a.doc_id < b.doc_id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges as (
    select x, y from links union all select y, x from links
), reach as (
    select doc_id as x, doc_id as y from lowest where rep = doc_id
    union
    select r.x, e.y from reach r join edges e on e.x = r.y
), roots as (
    select x, min(y) as root from reach group by x
)
select s.doc_id, coalesce(z.n, 0)::bigint as n_shingles, coalesce(r.root, s.doc_id)::bigint as component_id
from split s left join sized z on z.doc_id = s.doc_id left join lowest l on l.doc_id = s.doc_id left join roots r on r.x = l.rep
"""


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the lowest id.

    Documents without words are alone and all stay. Of several rows with that id the one with the
    lowest text stays. A row without an id goes if its component has an id, and stays otherwise.
    Documents whose id can't be in a component with others stay where they are; a filter of bounded
    size tells them.
    """
    own, components_of = classes(docs.select("doc_id", "text"))
    placed = written(own.where("n > 0").join(components_of, own["key"] == components_of["of"]).select("doc_id", "component_id"))
    several = placed.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("component_id").alias("c"))
    gone_id, lowest = fresh(docs, "gone_id", "lowest")
    ids = placed.join(several, placed["component_id"] == several["c"]).groupBy(F.col("doc_id").alias(gone_id)).agg(
        F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias(lowest)
    )
    ids = written(ids)
    if not ids.take(1):
        return docs
    known = Filter(ids.select(hash_of_id(F.col(gone_id)).alias("h")), "h")

    doubtful = known.may_have(hash_of_id(col(docs, "doc_id")))
    joined = docs.where(doubtful).join(ids, col(docs, "doc_id").eqNullSafe(ids[gone_id]), "left")
    columns = [col(joined, c) for c in docs.columns]
    alone = joined.where(F.col(gone_id).isNull() & F.col(lowest).isNull()).select(*columns)
    (row,) = fresh(docs, "row")
    first = (
        joined.where(F.col(lowest))
        .groupBy(F.col(gone_id))
        .agg(F.min_by(F.struct(*columns), F.coalesce(col(joined, "text"), F.lit(""))).alias(row))
        .select(*[F.col(row)[c].alias(c) for c in docs.columns])
    )
    return docs.where(~doubtful).unionByName(alone).unionByName(first)


def hash_of_id(doc_id):
    return F.xxhash64(F.lit("id"), doc_id)
