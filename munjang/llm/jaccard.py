"""N-gram Jaccard join with signature trees.

Documents with equal shingle sets form a class, and classes are joined. Two
sets of similarity t share one of the first n - ceil(t n) + 1 shingles of
each, in any fixed order of all shingles; the order is by frequency, as far as
a count sketch of fixed size over all documents tells it, so passages that
many documents share come last. Classes that share such a shingle form a
block. In a block a signature tree is built: leaves are classes, a node holds
the OR of its children's token bitmaps and the range of their sizes. A dual
traversal from the root drops pairs of nodes whose largest possible overlap is
too small, and pairs that are linked already. Blocks need only bitmaps and
sizes; the token sets of the pairs that are left are fetched and compared exactly.

Blocks have a bounded number of members. Large groups of near copies first
shrink: classes with the same smallest hash are joined, then one class for
each component and block; what still holds several components is compared in
full, chunk against chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.llm import shared
from munjang.llm.components import components
from munjang.llm.kernels import U64, document_shingles, pack, unpack

N_WORDS, PERCENT = 5, 75
#: Cells of the count sketch, members of a block that one task compares, entries of one shingle that one range gathers, postings that a task sends at a time.
CELL_BITS, BLOCK, SALT, RUN = 20, 256, 100_000, 1_000_000
#: Bits of a node's token bitmap, most bits of a class's own, children of a node, bits of the bitmap that picks the classes whose sets are needed.
TOKEN_BITS, OWN_BITS, FAN, PICK_BITS = 2048, 1 << 18, 8, 24
_SLICES = 16


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def features(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, n, cls) of each row; kind 1: slices of each task's count sketch of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        held, size = [], 0
        for batch in batches:
            n, cls = [], []
            for tokens in document_shingles(batch.column("text"), N_WORDS):
                n.append(len(tokens))
                cls.append(class_of(tokens) if len(tokens) else None)
                held.append(tokens)
                size += len(tokens)
                if size >= RUN:
                    cells += np.bincount((np.concatenate(held) >> U64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)).astype(np.uint32)
                    held, size = [], 0
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if held:
            cells += np.bincount((np.concatenate(held) >> U64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)).astype(np.uint32)
        blobs = [pack(x) for x in cells.reshape(_SLICES, -1)]
        k = _SLICES
        yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(blobs, pa.binary())], names)

    names = ["kind", "doc_id", "n", "cls", "part", "blob"]
    return docs.mapInArrow(run, "kind int, doc_id long, n long, cls long, part int, blob binary")


def frequency_order(sketches: DataFrame) -> np.ndarray:
    """For each cell 1000 * log2(1 + its count), as uint16: of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                total[part] = total.get(part, 0) + unpack(blob.as_py(), np.uint32).astype(np.int64)
        order = [np.rint(1000 * np.log2(1.0 + x)).astype(np.uint16).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(order, pa.binary())], ["part", "blob"])

    out = np.zeros((_SLICES, (1 << CELL_BITS) // _SLICES), np.uint16)
    for row in sketches.select("part", "blob").repartition(_SLICES, "part").mapInArrow(add, "part int, blob binary").collect():
        out[row["part"]] = np.frombuffer(row["blob"], np.uint16)
    return out.reshape(-1)


def prefix(tokens: np.ndarray, order: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(t n) + 1 tokens, rarest first, and their places in the frequency order."""
    n = len(tokens)
    rank = order[(tokens >> U64(64 - CELL_BITS)).astype(np.int64)]
    first = np.argsort(rank, kind="stable")[: n - (percent * n + 99) // 100 + 1]
    return tokens[first], rank[first]


def postings(docs: DataFrame, order: np.ndarray, ranges: int, percent: int) -> DataFrame:
    """Blocks: rows (key, members), members being the classes that share a prefix token. Keys of more than ``BLOCK`` classes give several rows."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, rank, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            home = (token & U64(0xFFFFFFFF)).astype(np.int64) % ranges
            # A token that very many documents hold goes to several ranges, by class.
            pieces = (2.0 ** (rank / 1000.0) / SALT).astype(np.int64) + 1
            salt = (cls & 0x7FFFFFFF) % pieces
            part = (home + salt) % ranges
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = []
            for p in full:
                rows = by[cuts[p] : cuts[p + 1]]
                wide = pieces[rows] > 1
                blobs.append(len(rows).to_bytes(8, "little") + pack((token[rows] >> U64(32)).astype(np.uint32)) + pack(cls[rows]) + pack(np.where(wide, salt[rows] + 1, 0).astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            for tokens in document_shingles(batch.column("text"), N_WORDS):
                if not len(tokens) or (cls := class_of(tokens)) in seen:
                    continue
                seen.add(cls)
                first, rank = prefix(tokens, sent.value, percent)
                held.append((first, rank, np.full(len(first), cls)))
                size += len(first)
                if size >= RUN:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in shared.by_group(batches, "part"):
            got = []
            for b in table["blob"]:
                blob = b.as_py()
                n = int.from_bytes(blob[:8], "little")
                got.append((unpack(blob[8 : 8 + 4 * n], np.uint32), unpack(blob[8 + 4 * n : 8 + 12 * n], np.int64), unpack(blob[8 + 12 * n :], np.uint32)))
            token, cls, salt = (np.concatenate(x) for x in zip(*got, strict=True))
            home = (int(part) - np.maximum(salt.astype(np.int64) - 1, 0)) % ranges
            key = (home << 32) | token.astype(np.int64)
            order = np.lexsort((cls, key))
            key, cls, wide = key[order], cls[order], salt[order] > 0
            new = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
            key, cls, wide = key[new], cls[new], wide[new]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(start, len(key)))
            keep = np.flatnonzero((count > 1) | wide[start])
            keys, members, bits, known = [], [], [], set()
            for a, n in zip(start[keep].tolist(), count[keep].tolist(), strict=True):
                if n <= BLOCK and not wide[a]:
                    if (own := cls[a : a + n].tobytes()) in known:  # pairs of near copies share many tokens
                        continue
                    known.add(own)
                for b in range(a, a + n, BLOCK):
                    keys.append(key[a])
                    members.append(cls[b : min(b + BLOCK, a + n)])
                    bits.append(n > BLOCK or wide[a])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(members, pa.list_(pa.int64())), pa.array(bits, pa.bool_())], ["key", "members", "large"])

    n = shared.partitions(docs.sparkSession)
    met = docs.mapInArrow(send, "part int, blob binary").repartition(n, "part").sortWithinPartitions("part")
    return met.mapInArrow(gather, "key long, members array<long>, large boolean")


def _of_classes(docs: DataFrame, picked: np.ndarray, columns: dict[str, tuple[str, pa.DataType, object]]) -> DataFrame:
    """``columns`` (SQL type, Arrow type, function of a token set) once for each class whose place in the bitmap is set."""
    sent = docs.sparkSession.sparkContext.broadcast(picked)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cls, rows = [], []
            for tokens in document_shingles(batch.column("text"), N_WORDS):
                if not len(tokens) or (c := class_of(tokens)) in seen:
                    continue
                at = (c & (1 << 64) - 1) >> (64 - PICK_BITS)
                if sent.value[at >> 3] >> (7 - (at & 7)) & 1:
                    seen.add(c)
                    cls.append(c)
                    rows.append([f(tokens) for _, _, f in columns.values()])
            values = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), *values], ["cls", *columns])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("cls").to_pylist()
            new = [i for i, c in enumerate(ids) if not (c in seen or seen.add(c))]
            yield batch.take(pa.array(new, pa.int64()))

    types = "cls long" + "".join(f", {name} {sql}" for name, (sql, _, _) in columns.items())
    return docs.mapInArrow(find, types).repartition(shared.partitions(docs.sparkSession), "cls").mapInArrow(once, types)


def token_bits(tokens: np.ndarray) -> bytes:
    """A bitmap of at least two places for each token, by the lowest bits of its hash; halves of it laid over each other make a smaller one."""
    width = TOKEN_BITS
    while width < 2 * len(tokens) and width < OWN_BITS:
        width *= 2
    bits = np.zeros(width, bool)
    bits[(tokens & U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def fold(bits: bytes, width: int = TOKEN_BITS) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width // 8), axis=0).view(U64)


def may_match(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """Whether the widest bitmaps that both have leave the overlap that a link needs."""
    width = 8 * min(len(a), len(b))
    x, y = fold(a, width), fold(b, width)
    over = min(na - int(np.bitwise_count(x).sum(dtype=np.int64)), nb - int(np.bitwise_count(y).sum(dtype=np.int64)))
    return (100 + percent) * (int(np.bitwise_count(x & y).sum(dtype=np.int64)) + over) >= percent * (na + nb)


def signatures(docs: DataFrame, picked: np.ndarray) -> DataFrame:
    """(cls, low, size, bits): smallest hash, number of tokens and token bitmap."""
    columns = {"low": ("long", pa.int64(), lambda x: int(x[:1].view(np.int64)[0])), "size": ("long", pa.int64(), len), "bits": ("binary", pa.binary(), token_bits)}
    return shared.save(_of_classes(docs, picked, columns), "signatures")


def token_sets(docs: DataFrame, picked: np.ndarray) -> DataFrame:
    """(cls, tokens)."""
    return _of_classes(docs, picked, {"tokens": ("binary", pa.binary(), lambda x: x.tobytes())})


class SignatureTree:
    """Levels of nodes over token sets: OR of bitmaps, range of sizes, most tokens beyond the set bits, range of labels."""

    def __init__(self, maps: np.ndarray, size: np.ndarray, labels: np.ndarray):
        over = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, over, labels, labels)]
        while len(self.levels[-1][1]) > FAN:
            maps, small, large, over, low, high = self.levels[-1]
            at = np.arange(0, len(small), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at), np.maximum.reduceat(over, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    @staticmethod
    def possible(a: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a link that is not there yet."""
        maps, small, large, over, low, high = a
        apart = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        need = np.maximum(percent * np.maximum(small[i], small[j]) / 100, percent * (small[i] + small[j]) / (100 + percent))
        most = np.minimum(large[i], large[j])
        ok = np.flatnonzero(apart & (most >= need - 1e-9))
        common = np.bitwise_count(maps[i[ok]] & maps[j[ok]]).sum(1, dtype=np.int64) + np.minimum(over[i[ok]], over[j[ok]])
        return ok[common >= need[ok] - 1e-9]

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Dual traversal from the root: pairs i < j of sets that the bounds leave."""
        i, j = np.triu_indices(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, 0, -1):
            keep = self.possible(self.levels[depth], i, j, percent)
            i, j = i[keep], j[keep]
            a, b = np.divmod(np.arange(FAN * FAN), FAN)
            i, j = (i[:, None] * FAN + a).ravel(), (j[:, None] * FAN + b).ravel()
            n = len(self.levels[depth - 1][1])
            ok = (i < n) & (j < n) & (i <= j)
            i, j = i[ok], j[ok]
        i, j = i[i < j], j[i < j]
        keep = self.possible(self.levels[0], i, j, percent)
        return i[keep], j[keep]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def candidates(blocks: DataFrame, signs: DataFrame, percent: int, star: bool) -> DataFrame:
    """Pairs (a, b, la, lb) of classes with different labels that the trees of their blocks (block, cls, label) leave. ``star``: for each class only the first partner of its block, to shrink groups of near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in shared.by_group(batches, "block"):
            if table.num_rows < 2:
                continue
            cls, label, size, low = (table[c].to_numpy() for c in ("cls", "label", "size", "low"))
            by = np.lexsort((cls, size, low))
            cls, label = cls[by], label[by]
            size, bits = size[by], table["bits"].to_pylist()
            bits = [bits[k] for k in by]
            i, j = SignatureTree(np.stack([fold(x) for x in bits]), size, label).pairs(percent)
            apart = label[i] != label[j]
            wide = np.array([8 * len(x) > TOKEN_BITS for x in bits])
            for k in np.flatnonzero(apart & wide[i] & wide[j]).tolist():
                apart[k] = may_match(bits[i[k]], bits[j[k]], int(size[i[k]]), int(size[j[k]]), percent)
            i, j = i[apart], j[apart]
            if star:
                order = np.lexsort((i, j))
                i, j = i[order], j[order]
                first = np.append(True, j[1:] != j[:-1])[: len(j)]
                i, j = i[first], j[first]
            if len(i):
                flip = cls[i] > cls[j]
                i, j = np.where(flip, j, i), np.where(flip, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cls[i], cls[j], label[i], label[j])], ["a", "b", "la", "lb"])

    n = shared.partitions(blocks.sparkSession)
    met = blocks.join(signs, "cls").select("block", "cls", "label", "size", "low", "bits").repartition(n, "block").sortWithinPartitions("block")
    return shared.save(met.mapInArrow(run, "a long, b long, la long, lb long").distinct(), "pairs")


def links(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Labels (a, b) of the pairs that are similar, compared exactly."""
    sets = token_sets(docs, shared.bitmap(pairs.selectExpr("a AS cls").union(pairs.selectExpr("b AS cls")), "cls", PICK_BITS))
    sets = shared.save(sets, "token-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    met = pairs.join(sets.selectExpr("cls AS a", "tokens AS x"), "a").join(sets.selectExpr("cls AS b", "tokens AS y"), "b")
    return met.selectExpr("la AS a", "lb AS b", "x", "y").mapInArrow(run, "a long, b long")


def relabel(docs: DataFrame, labels: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Labels after the similar ones of ``pairs`` are linked."""
    if pairs.isEmpty():
        return labels
    roots = components(links(docs, pairs, percent)).selectExpr("id AS label", "root")
    return shared.save(labels.join(roots, "label", "left").selectExpr("cls", "coalesce(root, label) AS label"), "labels")


def chunked(pairs: DataFrame, key: str) -> DataFrame:
    """(block, cls, label) for (key, cls, label): keys of more than ``BLOCK`` members are dealt into chunks."""
    sizes = pairs.groupBy(key).agg(F.count("*").alias("size")).where("size > 1")
    chunk = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / BLOCK).cast("long"))
    return pairs.join(sizes, key).select(F.xxhash64(key, chunk).alias("block"), "cls", "label")


def class_labels(docs: DataFrame, ready: DataFrame, percent: int) -> DataFrame:
    """(cls, label) of classes that share a prefix token with another; similar ones have one label."""
    spark = docs.sparkSession
    order = frequency_order(ready.where("kind = 1"))
    rows = postings(docs, order, 4 * shared.partitions(spark), percent)
    rows = shared.save(rows, "blocks")
    small = rows.where("NOT large").select(F.xxhash64("members").alias("key"), "members").groupBy("key").agg(F.first("members").alias("members"))
    blocks = small.withColumn("large", F.lit(False)).unionByName(rows.where("large"))
    members = shared.save(blocks.select("key", "large", F.explode("members").alias("cls")), "members")
    labels = members.select("cls").distinct().withColumn("label", F.col("cls"))
    signs = signatures(docs, shared.bitmap(labels, "cls", PICK_BITS))

    # Classes with the same smallest hash, chunk by chunk; then one class for each component.
    low = signs.select("cls", "low").join(labels, "cls")
    labels = relabel(docs, labels, candidates(chunked(low, "low"), signs, percent, True), percent)
    at = members.join(labels, "cls")
    one_each = shared.save(at.groupBy("key", "label").agg(F.min("cls").alias("cls"), F.count("*").alias("n")), "one-each")
    # Keys of few members with a label each are compared in full by this round.
    rest = one_each.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels")).where((F.col("n") > F.col("labels")) | (F.col("n") > BLOCK)).select("key")
    one_each = one_each.drop("n")
    labels = relabel(docs, labels, candidates(chunked(one_each, "key"), signs, percent, False), percent)

    # What still holds several components, in full. Keys of many members with one most frequent label are taken as one group, as a
    # group of near copies shares many keys; its members of that label are not compared among themselves.
    at = shared.save(members.join(rest, "key").join(labels, "cls"), "members")
    per_label = at.groupBy("key", "label").agg(F.count("*").alias("n"))
    keys = per_label.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
    at = at.join(keys.select("key", "size", "main"), "key")
    blocks = at.where(F.col("size") <= BLOCK).select(F.xxhash64("key").alias("block"), "cls", "label")
    half = BLOCK // 2
    many = at.where(F.col("size") > BLOCK).select("main", "cls", "label", (F.col("label") == F.col("main")).alias("inner")).distinct()
    parts = many.groupBy("main").agg(*(F.greatest(F.lit(1), F.ceil(F.count_if(c) / half)).cast("long").alias(k) for k, c in (("inners", F.col("inner")), ("others", ~F.col("inner")))))
    many = many.join(parts, "main").withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("inner"), F.col("inners")).otherwise(F.col("others"))))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")
    block = lambda *x: F.xxhash64(F.col("main"), *x).alias("block")
    inner = many.where("inner").select("*", each("others")).select(block(F.lit(0), "own", "other"), "cls", "label")
    outer = many.where("NOT inner").select("*", each("inners")).select(block(F.lit(0), "other", "own"), "cls", "label")
    among = many.where("NOT inner AND others > 1").select("*", each("others")).select(block(F.lit(1), F.least("own", "other"), F.greatest("own", "other")), "cls", "label")
    blocks = blocks.unionByName(inner).unionByName(outer).unionByName(among)
    return relabel(docs, labels, candidates(blocks, signs, percent, False), percent)


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Documents without words (null, empty, white space) have no shingles and are
    linked with nothing; of fewer than five words the whole sequence is one
    shingle. Repeated rows are rows of one class. A null doc_id stays null and
    is no component's name; its component is that of the other documents it is
    linked with, null if there are none.
    """
    texts = shared.texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ready = shared.save(features(texts), "features")
    labels = class_labels(texts, ready, percent)
    rows = ready.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "cls")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels, "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    named = shared.save(named, "classes")
    of_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(of_label, "label").select("cls", "component_id")
    return rows.join(found, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the first of its component. Equal rows of one doc_id become one; rows without a doc_id, which no component names, stay."""
    firsts = join(docs, percent).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
often AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS MATERIALIZED (SELECT doc_id, g FROM s JOIN often USING (g)),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 75 * (na.n + nb.n - k)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
