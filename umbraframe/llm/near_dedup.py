"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

1. One pass hashes the words of every document, digests their sequence (copies share it) and counts in how many
   documents each hashed shingle of five words stands, in a count-min sketch of two rows of ``BUCKETS`` counters.
   What a sketch counts too much is a share of the documents that does not grow with their number, so document frequencies are
   exact enough above ``FLOOR`` of the documents, and shingles below it all have that frequency's idf: at any size frequent
   passages are discounted and rare ones are alike.
2. The documents of one digest are a node; that of the smallest id (of null ids only: any) represents it. Its shingles weigh
   tf x min(1, idf / (SLACK x median idf of its own shingles)), idf = ln(1 + N / df): a passage that is far more common than the
   document's own text counts little, while a large group of near copies does not discount the text it shares.
3. Improved consistent weighted sampling takes ``BANDS * ROWS`` samples (shingle, quantised weight); the samples of
   each band are hashed to a key. Documents of one key are candidates.
4. In keys of up to ``SMALL`` documents all pairs are compared. A larger key is ordered by the keys of its documents'
   following bands, so that those that agree in most bands lie side by side; each is compared with the one before it and
   with the smallest node, once in each of its keys: a forest of ``BANDS`` orders, linear in the size of a group.
   Pairs of at least ``SIMILARITY`` weighted Jaccard, over whole texts, are links.
5. In larger keys that still hold several classes, all pairs of different classes are compared, in blocks of texts against
   blocks of texts, so that no link between documents of one key is lost at any size. Only the key's largest class is not
   compared with itself: the work is the product of a key's documents and those outside its largest class.
   The components of all links are the classes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbraframe.llm.common import ready, release_memory, table, whole_text, written
from umbraframe.llm.pretok import text_parts

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: A shingle is discounted from this share of the median idf down: below the counters' own spread nothing is.
SLACK = 0.8
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
SEGMENTS = 64
#: The least share of the documents that a document frequency counts as; at least OVER times what the sketch counts too much.
FLOOR, OVER = 1 / 128, 4
SMALL = 12
#: Documents, and characters, that a block of an exact comparison holds on average.
BLOCK_ROWS, BLOCK_CHARS = 1_000, 4_000_000
SALTS = 16

_U = np.uint64
_ODD, _MIX, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: An odd factor for each place in a shingle.
_PLACES = np.arange(1, 2 * SHINGLE, 2).astype(_U) * _ODD
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(30)) * _MIX
    h = (h ^ h >> _U(27)) * _MIX2
    return h ^ h >> _U(31)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as needed."""

    base = 0x5851F42D4C957F2D

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, self.base, _U)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, pow(self.base, -1, 1 << 64), _U)]))
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each white-space separated word, from prefix sums over the bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, _U)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)])])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each run of five words; of all words where there are fewer."""
    n = len(words)
    if not n:
        return words
    width = min(n, SHINGLE)
    out = np.zeros(n - width + 1, _U)
    for k in range(width):
        out += words[k : n - width + 1 + k] * _PLACES[k]
    return _mixed(out)


def digest(words: np.ndarray) -> bytes:
    """128 bits of the sequence of words."""
    if not len(words):
        return b"\0" * 16
    up, _ = _POWERS(len(words) + 1)
    a = np.sum(words * up[: len(words)])
    b = np.sum(_mixed(words ^ _ODD) * (up[: len(words)] * _MIX2 | _U(1)))
    return np.array([a, b], _U).tobytes()


def buckets(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's counter in either row of the sketch."""
    return (s >> _U(64 - BUCKET_BITS)).astype(np.int64), (s >> _U(64 - 2 * BUCKET_BITS) & _U(BUCKETS - 1)).astype(np.int64)


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """idf by row and counter; a shingle's is the greater of its two, as its document frequency is at most either count."""
    share = max(FLOOR, OVER * float(df[0].sum()) / BUCKETS / max(n, 1))
    return np.log1p(n / np.maximum(df, max(share * n, 1e-9))).astype(np.float32)


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles in order, their weights)."""
    s, tf = np.unique(shingles(word_hashes(text)), return_counts=True)
    if not len(s):
        return s, np.zeros(0)
    i, j = buckets(s)
    x = np.maximum(idf[0][i], idf[1][j])
    return s, tf * np.minimum(1.0, x / (SLACK * np.median(x)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least)


class Sampler:
    """Improved consistent weighted sampling. The random (r, beta) and c of a shingle and a sample, r and c ~ Gamma(2, 1) and
    beta ~ U(0, 1), are drawn by its hash from tables of 65,536 values each.

    For weight w: t = floor(ln w / r + beta), ln y = r (t - beta), and the shingle of least ln a = ln c - ln y - r is
    taken with its t. Most weights are 1, for which t is 0 and r (1 - beta) is a table of its own.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self.r = rng.gamma(2.0, 1.0, 65_536).astype(np.float32)
        self.beta = rng.random(65_536, np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, 65_536)).astype(np.float32)
        self.of_one = (self.r * (1 - self.beta)).astype(np.float32)

    def __call__(self, s: np.ndarray, w: np.ndarray, block: int = 512) -> np.ndarray:
        """A 64-bit hash of the (shingle, t) that each sample takes."""
        best = np.full(len(self.odd), np.inf, np.float32)
        taken = np.zeros(len(self.odd), _U)
        each = np.arange(len(self.odd))
        ones = w == 1
        for some, log_w in ((s[ones], None), (s[~ones], np.log(w[~ones]).astype(np.float32))):
            for i in range(0, len(some), block):
                part = some[i : i + block]
                h = part[None, :] * self.odd[:, None]
                pair = (h >> _U(48)).astype(np.intp)
                c = self.log_c.take((h >> _U(32) & _U(65_535)).astype(np.intp))
                if log_w is None:
                    a = c - self.of_one.take(pair)
                else:
                    r, beta = self.r.take(pair), self.beta.take(pair)
                    t = np.floor(log_w[None, i : i + block] / r + beta)
                    a = c - r * (t - beta + 1)
                at = a.argmin(1)
                low = a[each, at]
                better = np.nonzero(low < best)[0]
                best[better] = low[better]
                value = part[at[better]]
                if log_w is not None:
                    value = value + t[better, at[better]].astype(np.int64).astype(_U) * _MIX
                taken[better] = _mixed(value)
        return taken


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1).astype(_U) * _ODD
    for k in range(ROWS):
        key = _mixed(key ^ rows[:, k]) * _ODD
    return key


# ---- stages


def text_mark(text: Column) -> Column:
    """128 bits of a text: with the id they name a row, whatever repeats or is null."""
    return F.unhex(F.md5(text.cast("binary")))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(whole_text(text_col)).alias("mark"), whole_text(text_col).alias("text"))


def digests_and_frequencies(slim: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(doc_id, mark, digest) of every row; the idf of every counter; the number of rows."""
    segment = 2 * BUCKETS // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        df, n = np.zeros((2, BUCKETS), np.int32), 0
        for batch in batches:
            out = []
            for _, texts in text_parts(batch.column(2), 2_000_000):
                held = []
                for text in texts:
                    words = word_hashes(text)
                    out.append(digest(words))
                    held.append(np.unique(shingles(words)))
                for row, at in zip(df, buckets(np.concatenate(held)), strict=True):
                    row += np.bincount(at, minlength=BUCKETS).astype(np.int32)
            n += len(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())], names)
        if n:
            parts = [(-1, np.array([n], np.int64)), *enumerate(np.split(df.reshape(-1), SEGMENTS))]
            none = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([i for i, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], names)

    names = ["doc_id", "mark", "digest", "segment", "counts"]
    both = written(slim.transform(ready).mapInArrow(run, "doc_id long, mark binary, digest binary, segment int, counts binary"), "near-digests")

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int32 if len(c) == 4 * segment else np.int64).astype(np.int64) for c in rows.column("counts").to_pylist())
        return pa.table({"segment": pa.array([rows.column("segment")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    # Two steps, so that no task adds up what all tasks have counted. The sums are 2 x BUCKETS numbers at any size.
    counts = both.filter("segment IS NOT NULL").select("segment", "counts", (F.spark_partition_id() % 32).alias("deal"))
    once = counts.groupBy("segment", "deal").applyInArrow(add, "segment int, counts binary")
    sums = {r.segment: np.frombuffer(bytes(r.counts), np.int64) for r in once.groupBy("segment").applyInArrow(add, "segment int, counts binary").collect()}
    n = int(sums[-1][0]) if sums else 0
    df = np.concatenate([sums[i] for i in range(SEGMENTS)]).reshape(2, BUCKETS) if sums else np.zeros((2, BUCKETS), np.int64)
    idf = idf_table(df, n)
    del sums, df
    release_memory()
    return both.filter("segment IS NULL").select("doc_id", "mark", "digest"), idf, n


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row a digest: digest, node (a number), rep_id and rep_mark (the row that represents it), n_same (rows equal to that), n_copies."""
    each = rows.groupBy("digest", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n_same"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n_same")).alias("one")
    found = each.groupBy("digest").agg(one, F.sum("n_same").alias("n_copies"))
    return written(found.select("digest", F.monotonically_increasing_id().alias("node"), F.col("one.doc_id").alias("rep_id"), F.col("one.mark").alias("rep_mark"), F.col("one.n_same").alias("n_same"), "n_copies"), "near-copies")


def of_nodes(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """(node, columns) of the row (doc_id, mark) that represents each node, once where it repeats."""
    reps = nodes.select("node", "n_same", F.col("rep_id").alias("_rep"), F.col("rep_mark").alias("_mark"))
    found = rows.join(reps, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_rep"))).select("node", *columns)
    return found.dropDuplicates(["node"]) if nodes.filter("n_same > 1").head(1) else found


def keys_of(slim: DataFrame, idf) -> DataFrame:
    """(doc_id, mark, keys), the bands' keys of each row of (doc_id, mark, text) where it lies; none for documents without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        sampler, table_, recent = Sampler(), idf.value, OrderedDict()
        for batch in batches:
            at, keys = [], []
            for i, (same, cell) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if same not in recent:
                    s, w = weighted(cell.as_py(), table_)
                    recent[same] = band_keys(sampler(s, w)).view(np.int64).tolist() if len(s) else None
                    if len(recent) > 4_096:
                        recent.popitem(last=False)
                if recent[same]:
                    at.append(i)
                    keys.append(recent[same])
            if at:
                held = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(held), batch.column(1).take(held), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "keys"])

    return slim.transform(ready).mapInArrow(run, "doc_id long, mark binary, keys array<long>")


def rows_of_keys(keyed: DataFrame) -> DataFrame:
    """(key, then, last, rep) of each band of each row, with the keys of the two bands that follow."""
    at = keyed.select(F.col("node").alias("rep"), "keys", F.posexplode("keys").alias("i", "key"))
    following = (F.expr(f"keys[pmod(i + {k}, {BANDS})]").alias(name) for k, name in ((1, "then"), (2, "last")))
    return at.select("key", *following, "rep")


def first_pairs(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of small keys, and of large ones those with the smallest id and with the neighbour in order."""
    held = keys.join(sizes, "key")
    small = held.filter(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("rep")).alias("reps"))
    spread = small.select(F.posexplode("reps").alias("i", "a"), "reps").select("a", F.explode(F.expr("slice(reps, i + 2, size(reps))")).alias("b"))
    large = held.filter(F.col("n") > SMALL)
    star = large.filter("rep > center").select(F.col("center").alias("a"), F.col("rep").alias("b"))
    # Salted by the next band's key only, which keeps the most similar together: parts of the ids would part near copies in every key.
    line = Window.partitionBy("key", F.pmod(F.xxhash64("then"), F.lit(SALTS))).orderBy("then", "last", "rep")
    chain = large.select(F.lag("rep").over(line).alias("x"), F.col("rep").alias("y")).filter("x IS NOT NULL AND x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return spread.unionByName(star).unionByName(chain).distinct()


def texts_of(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes of pairs."""
    needed = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()
    held = written(nodes.join(needed, F.col("node") == F.col("_id"), "left_semi"), "near-needed")
    return of_nodes(texts, held.hint("merge"), "text")


def links_of(pairs: DataFrame, some: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least the similarity, by their whole texts.

    The ids and texts of candidates grow with the input: these joins are merges at every size, never broadcasts.
    """
    left = some.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = some.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        table_, recent = idf.value, OrderedDict()

        def of(doc: int, text) -> tuple:
            if doc not in recent:
                recent[doc] = weighted(text.as_py(), table_)
                if len(recent) > 256:
                    recent.popitem(last=False)
            return recent[doc]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hit = [weighted_jaccard(of(x, tx), of(y, ty)) >= similarity - 1e-9 for x, y, tx, ty in zip(a, b, batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    # The text of a much linked document comes to its pairs; skewed partitions of pairs are split by the planner.
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b").transform(ready).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each linked id's component, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "near-edges")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if tuple(row) == mark or not row[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        mark = tuple(row)


def cross_links(docs: list[tuple], key: int, within: bool, idf: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between the classes of documents (label, side, keys, text): of all pairs of one block, or of side 0 with side 1.

    A pair is left to the smallest key that its documents share. Once two classes are linked they are one here.
    """
    labels, side = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs])
    found = np.array(labels)
    lower = [[k for k in d[2] if k < key] for d in docs]
    held = np.full((len(docs), BANDS), key, np.int64)
    for i, some in enumerate(lower):
        held[i, : len(some)] = some
    vectors = [weighted(d[3], idf) for d in docs]
    total, sizes = np.array([float(w.sum()) for _, w in vectors]), np.array([len(s) for s, _ in vectors])
    at, w = np.unique(np.concatenate([s for s, _ in vectors]), return_inverse=True)[1], np.concatenate([w for _, w in vectors])
    ends, out = np.cumsum(sizes), []
    dense = np.zeros(int(at.max()) + 1)
    for a in range(len(docs)):
        # No more than the lesser of two weights is shared.
        other = (found != found[a]) & (np.minimum(total, total[a]) >= (similarity - 1e-9) * np.maximum(total, total[a]))
        other &= np.arange(len(docs)) > a if within else (side == 1) & (side[a] == 0)
        if lower[a] and other.any():
            other[other] = ~np.isin(held[other], lower[a]).any(1)
        if not other.any():
            continue
        own = slice(ends[a] - sizes[a], ends[a])
        dense[at[own]] = w[own]
        rows, b = np.repeat(other, sizes), np.nonzero(other)[0]
        least = np.add.reduceat(np.minimum(dense[at[rows]], w[rows]), np.cumsum(sizes[b]) - sizes[b])
        dense[at[own]] = 0
        for x in b[least / (total[a] + total[b] - least) >= similarity - 1e-9]:
            if found[x] != found[a]:
                out.append((int(min(labels[x], labels[a])), int(max(labels[x], labels[a]))))
                found[found == found[x]] = found[a]
    return out


def more_links(keys: DataFrame, sizes: DataFrame, labels: DataFrame, some: DataFrame, idf, similarity: float) -> DataFrame:
    """(a, b): links between the labels of classes that large keys still hold, by all pairs of documents of different classes.

    Documents of a key are dealt to blocks, those of its largest class to blocks of their own, and each two blocks are
    compared as a group unless both are of the largest class.
    """
    held = keys.select("key", "rep").join(sizes.filter(F.col("n") > SMALL).select("key"), "key").join(labels.hint("merge"), F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    most = held.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("label", F.struct("n", "label")).alias("_most"))
    held = written(held.join(most.filter("classes > 1").drop("classes"), "key").withColumn("rest", (F.col("label") != F.col("_most")).cast("int")).drop("_most"), "near-open")
    docs = held.groupBy("rep").agg(F.collect_list("key").alias("keys"))
    texts = written(some.join(docs.hint("merge"), F.col("node") == F.col("rep"), "inner").select("rep", "keys", "text"), "near-open-texts")
    held = held.join(texts.select("rep", F.length("text").alias("_chars")).hint("merge"), "rep")
    blocks = lambda rest: F.ceil(F.greatest(F.sum((F.col("rest") == rest).cast("int")) / BLOCK_ROWS, F.sum(F.when(F.col("rest") == rest, F.col("_chars")).otherwise(0)) / BLOCK_CHARS, F.lit(1)))
    dealt = held.drop("_chars").join(held.groupBy("key").agg(blocks(0).alias("_n0"), blocks(1).alias("_n1")), "key")
    # Blocks 0 to _n0 - 1 are the largest class's.
    block = F.when(F.col("rest") == 1, F.col("_n0") + F.pmod(F.xxhash64("rep"), F.col("_n1"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("_n0")))
    with_ = F.explode(F.sequence(F.when(F.col("rest") == 1, F.lit(0)).otherwise(F.col("_n0")), F.col("_n0") + F.col("_n1") - 1))
    met = dealt.withColumn("block", block).withColumn("with", with_)
    met = met.select("key", "rep", "label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("side"))

    def run(group: pa.Table) -> pa.Table:
        docs = list(zip(*(group.column(c).to_pylist() for c in ("label", "side", "keys", "text")), strict=True))
        first = group.slice(0, 1).to_pylist()[0]
        out = cross_links(docs, first["key"], first["i"] == first["j"], idf.value, similarity)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return met.join(texts.hint("merge"), "rep").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest id of its class), rep_id (of its exact copies), class_size, kept, class_key, mark.

    class_key numbers the classes of one call. Of a class the rows of the smallest id are kept, of several texts with that id those
    of one. Defined cases: a null text is empty; documents without words are one class; texts of fewer than five words
    are one shingle; rows with a null id are classed by their texts and never kept where one with an id is; a class of
    null ids only has a null class_id and a class_key of its own, and one of its texts is kept; an id that repeats with different texts
    stands for each of them; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    spark, slim = docs.sparkSession, _slim(docs, id_col, text_col)
    rows, idf, _ = digests_and_frequencies(slim)
    shared = spark.sparkContext.broadcast(idf)  # 2 x BUCKETS numbers
    nodes = nodes_of(rows)
    # Every row's keys are taken where its text lies, and those of copies dropped after: no text is shuffled for them.
    keys = rows_of_keys(of_nodes(written(keys_of(slim, shared), "near-keyed"), nodes, "keys"))
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("center"), F.max("rep").alias("_high")).filter("center <> _high").drop("_high"), "near-sizes")
    keys = written(keys.join(sizes.select("key"), "key", "left_semi"), "near-held")
    pairs = written(first_pairs(keys, sizes), "near-pairs")
    some = written(texts_of(pairs, nodes, slim), "near-texts")
    links = written(links_of(pairs, some, shared, similarity), "near-links")
    labels = components(links)
    # Each document of a large key has a pair, so its text is among those of pairs.
    more = written(more_links(keys, sizes, labels, some, shared, similarity), "near-more")
    classes = nodes.join(labels, F.col("node") == F.col("id"), "left").select("digest", "rep_id", "rep_mark", "n_copies", F.coalesce("label", "node").alias("class_key"))
    if more.head(1):  # links between classes, by their labels: only these are joined further
        joined = components(more).select(F.col("id").alias("_from"), F.col("label").alias("_to"))
        classes = classes.join(joined, F.col("class_key") == F.col("_from"), "left").withColumn("class_key", F.coalesce("_to", "class_key")).drop("_from", "_to")
    classes = written(classes, "near-classes")
    first = F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "rep_mark")).alias("first")
    total = classes.groupBy("class_key").agg(F.sum("n_copies").alias("class_size"), first).withColumnRenamed("class_key", "_class")
    classes = classes.join(total, F.col("class_key") == F.col("_class")).select("digest", "rep_id", "class_key", "class_size", F.col("first.rep_id").alias("class_id"), F.col("first.rep_mark").alias("_kept_mark"))
    # One digest may hold a third of the rows: both sides are salted.
    salted = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        .join(salted, ["digest", "_salt"])
        .select("doc_id", "class_id", "rep_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("_kept_mark"))).alias("kept"), "class_key", "mark")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns; of repeated rows of it one stays."""
    kept = near_classes(docs, id_col, text_col).filter("kept").groupBy(F.col("doc_id").alias("_keep"), F.col("mark").alias("_keep_mark")).agg(F.count(F.lit(1)).alias("_rows"))
    kept = written(kept, "near-kept")
    marked = docs.withColumn("_mark_of", text_mark(whole_text(text_col)))
    out = marked.join(kept.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("_keep")) & (F.col("_mark_of") == F.col("_keep_mark")), "left_semi")
    if kept.filter("_rows > 1").head(1):  # only then is there a row to drop, and a second shuffle worth it
        out = out.dropDuplicates([id_col, "_mark_of"])
    return out.drop("_mark_of")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).drop("mark")
