"""SimHash near-duplicates: pigeonring candidates over distinct fingerprints, then components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, join_least, thinned
from .tables import attach, in_small_batches, materialise
from .text import mix64, slices, words

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ring(most: int) -> tuple[int, ...]:
    """The ring's segments in bits: more of them than differing bits, so a chain can begin in a segment without any."""
    if not 0 <= most < 32:
        raise ValueError(f"most must be 0 to 31 differing bits, not {most}")
    m = max(5, most + 1)
    return tuple(64 // m + (i < 64 % m) for i in range(m))


#: Most pairs of a run of equal keys held in a task before they are reduced.
PAIRS = 1 << 19
#: Most texts and shingles of a block, of which a task compares two.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 18

#: The bits of a byte, one in each byte of a 64-bit number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes a number whose bits are set in over half of the run; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    counts = counts[some]
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    parts = -(-counts // 255)  # sums of up to 255 bits fit a byte
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(begin, parts) + 255 * inner
    ones = np.empty((len(counts), 64), np.int64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], at).view(np.uint8).reshape(-1, 8)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.astype(np.int64), np.cumsum(parts) - parts, axis=0)
    out[some] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


#: Least hashes of shingles that make a band, and bands of a text: of two texts that share 0.8 of their shingles 0.998 have
#: a band in common, of those that share 0.4 less than 0.08.
BAND, BANDS = 6, 20


def band_keys(hashes: np.ndarray, counts: np.ndarray, bands: int, rows: int = BAND) -> np.ndarray:
    """For each run of counts[i] > 0 hashes its bands, a hash each: of the least values of `rows` permutations of the run."""
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    odd = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.repeat(mix64(np.arange(bands, dtype=np.uint64) + np.uint64(77))[None, :], len(counts), axis=0)
    for k, a in enumerate(odd):
        out[:, k // rows] = mix64(out[:, k // rows] + np.minimum.reduceat(hashes * a, begin))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, bands: int = 0) -> DataFrame:
    """doc_id, text_key (hash of the text) and fp (long, the unsigned bits) of every document, with `bands` its bands too."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch, texts in slices(batches, "text"):
            w = words(texts, lower=True)
            hashes, counts, at, data = [], [], w.first, w.data.tobytes()
            for i, n in enumerate(w.count):
                line = b" ".join(data[w.bounds[i] : w.bounds[i + 1]].split())
                size = (w.end - w.start)[at[i] : at[i + 1]]
                to = np.cumsum(size + 1) - 1
                start = np.concatenate([[0], to[:-1] + 1]) if n else to
                k = max(1, n - shingle + 1) if n else 0
                last = to[shingle - 1 :] if n >= shingle else to[-1:]
                hashes += [digest(line[a:b], seed) for a, b in zip(start[:k].tolist(), last.tolist())]
                counts.append(k)
            hashes, counts = np.asarray(hashes, np.uint64), np.asarray(counts)
            columns = [batch.column(0), batch.column(1), pa.array(majority(hashes, counts).view(np.int64))]
            if bands:
                some = np.flatnonzero(counts)
                keys = band_keys(hashes, counts[some], bands).view(np.int64).ravel() if len(some) else np.zeros(0, np.int64)
                size = np.where(counts > 0, bands, 0)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp", "bands"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return in_small_batches(rows).mapInArrow(hashed, "doc_id long, text_key long, fp long" + ", bands array<bigint>" * bool(bands))


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def segments(fp: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """The ring's segments of each fingerprint, one column for each."""
    at = np.cumsum((0, *sizes[:-1]))
    return np.stack([(fp >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in zip(at, sizes)], axis=1)


def closest(pairs: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) in which b is the least or one of the `nearest` (by bits, then number) of a's partners; each a
    that has more of them."""
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    least = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])
    order = np.lexsort((pairs[:, 1], np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]), pairs[:, 0]))
    first = np.flatnonzero(least)
    rank = np.empty(len(pairs), np.int64)
    rank[order] = np.arange(len(pairs)) - np.repeat(first, np.diff(np.append(first, len(pairs))))
    keep = least | (rank < nearest)
    return pairs[keep], np.unique(pairs[~keep, 0])


def links(fps: DataFrame, most: int = 4, block: int = 4096, nearest: int = 0) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at `most` or fewer bits, enough of them to connect all that are so linked.

    With m segments, 5 and more than `most`, some chain of consecutive segments has at most floor(most * l / m) differences after each
    of its first l segments: none in the first, at most one in the first two. Each fingerprint is stored under its
    two segments from every start, and looks up those two segments with none or one bit of the second changed.
    Rows of one start and key meet in one task, sorted; there the chain goes on to three and four segments before
    the whole distance is taken. The more bits, the shorter the keys and the more rows meet under each. A key with over
    `block` stored rows is dealt: its stored rows and its lookups are both cut in blocks, and each pair of blocks is a
    run of its own. Of the pairs of a run a spanning forest is kept, never all.

    With `nearest`, for callers who look closer at pairs, each row's so many nearest partners of a run are kept instead,
    and its least one; rows (a, a, run) name all that have more partners in that run, so callers can go through the rest.
    Rows of pairs have run -1; without `nearest` there is no such column.
    """
    sizes = ring(most)
    m = len(sizes)
    budget = [most * (k + 1) // m for k in range(m)]

    def keyed(batches: Iterator[pa.RecordBatch], lookups: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            seg = segments(fp, sizes)
            for i in range(m):
                j = (i + 1) % m
                for flip in range(-1, sizes[j] if lookups else 0):
                    second = seg[:, j] ^ np.uint64(1 << flip if flip >= 0 else 0)
                    key = (np.uint64(i) << np.uint64(26)) | (seg[:, i] << np.uint64(13)) | second
                    for stored in (True, False)[: 1 + lookups] if flip < 0 else (False,):
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(np.full(len(fp), stored)), batch.column(0)], names=["key", "stored", "fp"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .components import forest

        def solve(key, stored, fp) -> np.ndarray:
            """Rows (a, b, run) of whole runs of equal keys."""
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([edge, [len(key)]]))
            n_stored = np.add.reduceat(stored.astype(np.int64), edge)
            out = []
            use = (n_stored > 0) & (size - n_stored > 0) & (size > 2)
            for at, n, s in zip(edge[use], size[use], n_stored[use]):
                a, b = fp[at : at + s], fp[at + s : at + n]  # stored rows come first
                start = int(key[at] >> 26) % 32
                pairs, more = np.zeros((0, 2), np.uint64), []

                def fewer() -> np.ndarray:
                    if not nearest:
                        return forest(pairs)
                    kept, over = closest(pairs, nearest)
                    more.append(over)
                    return kept

                for lo in range(0, s, 512):
                    for lo_b in range(0, n - s, 2048):
                        x, y = a[lo : lo + 512], b[lo_b : lo_b + 2048]
                        diff = x[:, None] ^ y[None, :]
                        seg_at = np.cumsum((0, *sizes[:-1]))
                        keep, seen = None, 0
                        for k in range(3, m + 1):
                            mask = sum(((1 << sizes[(start + j) % m]) - 1) << int(seg_at[(start + j) % m]) for j in range(k))
                            if keep is None:
                                ok = np.bitwise_count(diff & np.uint64(mask)) <= budget[k - 1]
                                keep = np.flatnonzero(ok.ravel())
                            else:
                                keep = keep[np.bitwise_count(diff.ravel()[keep] & np.uint64(mask)) <= budget[k - 1]]
                        u, v = x[keep // len(y)], y[keep % len(y)]
                        pairs = np.concatenate([pairs, np.stack([u, v], axis=1)[u != v]])
                        if len(pairs) > PAIRS:
                            pairs = fewer()
                if len(pairs):
                    pairs = fewer()
                    out.append(np.column_stack([pairs, np.full(len(pairs), -1).view(np.uint64)]))
                if more:
                    over = np.unique(np.concatenate(more))
                    out.append(np.column_stack([over, over, np.full(len(over), key[at], np.int64).view(np.uint64)]))
            return np.concatenate(out) if out else np.zeros((0, 3), np.uint64)

        def told(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy().view(np.int64)) for k in range(3)], names=["a", "b", "run"])

        rest = None
        for batch in batches:
            now = [np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8())).astype(bool), np.asarray(batch.column(2)).view(np.uint64)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            whole = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            if whole:
                yield told(solve(*(x[:whole] for x in now)))
            rest = [x[whole:] for x in now]
        if rest is not None and len(rest[0]):
            yield told(solve(*rest))

    rows = fps.select("fp").mapInArrow(keyed, "key int, stored boolean, fp long")
    stored = fps.select("fp").mapInArrow(lambda it: keyed(it, False), "key int, stored boolean, fp long")
    hot = stored.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    hot = materialise(hot, "hot-keys")
    if hot.isEmpty():
        dealt = rows.select(F.col("key").cast("long").alias("key"), "stored", "fp")
    else:
        # lookups of a key are at most 65 times its stored rows and those of its neighbours, so as many blocks do
        n, mine = F.col("blocks").cast("long"), F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long"))
        every = F.sequence(F.lit(0).cast("long"), n - 1)
        own = F.when(F.col("stored"), F.transform(every, lambda x: mine * n + x)).otherwise(F.transform(every, lambda x: x * n + mine))
        blocks = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(own)
        dealt = rows.join(hot, "key", "left").withColumn("__block", F.explode(blocks))
        dealt = dealt.select((F.col("__block") * F.lit(1 << 31) + F.col("key")).alias("key"), "stored", "fp")
    ordered = dealt.repartition("key").sortWithinPartitions("key", F.col("stored").desc())
    found = ordered.mapInArrow(met, "a long, b long, run long")
    return found if nearest else found.drop("run")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    Null and empty texts have fingerprint zero and link like any other. Copies share a fingerprint and so a
    component; a repeated row appears as often as it is given. A null doc_id takes no part in choosing the
    component's name. An empty table gives no rows. Other columns are ignored.
    """
    rows = materialise(fingerprints(docs, shingle), "fingerprints")
    names = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("name")), "classes")
    pairs = links(names, most)
    named = components(names.select(F.col("fp").alias("node"), "name"), pairs)
    joined = rows.join(named.withColumnRenamed("node", "fp"), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """text_key and shingles (distinct hashes) of docs(text_key, text), whole texts with fewer words as one shingle."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            sets = []
            for text in texts:
                w = text.translate(_LOWER).split()
                sets.append(sorted({xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle])) - (1 << 63) for i in range(max(1, len(w) - shingle + 1))} if w else ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["text_key", "shingles"])

    return in_small_batches(docs.select("text_key", "text")).mapInArrow(told, "text_key long, shingles array<bigint>")


def alike(edges: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The edges(a, b) of text_keys whose shingles overlap by `share` or more of all their distinct ones (Jaccard).

    An edge's texts meet by two joins; a text with very many edges is copied to several tasks.
    """
    degree = edges.groupBy(F.col("a").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    own = degree.join(sets, degree["u"] == sets["text_key"]).select("u", F.col("shingles").alias("m"), "n")
    met = join_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), own, edges.count())
    met = met.join(sets.withColumnRenamed("text_key", "v"), "v")
    both = F.size(F.array_intersect("m", "shingles"))
    return met.where(both >= F.lit(share) * (F.size("m") + F.size("shingles") - both)).select(F.col("u").alias("a"), F.col("v").alias("b"))


BY_KEY, BY_FINGERPRINT, BY_BAND = 0, 1, 2


def rest_alike(members: DataFrame, sets: DataFrame, most: int, share: float) -> DataFrame:
    """Pairs (a, b) of text_keys that connect all texts of a run which link and are of different components yet.

    members(kind, run, text_key, fp, component); a run's texts are cut in blocks and each pair of blocks is a task's group.
    A text of a run is compared with those at `most` or fewer bits from whose component it is still apart, so groups
    of near copies need few comparisons; texts that are near by bits alone need all. Runs of kind BY_BAND have a band in
    common and no limit of bits.
    """
    sized = members.join(sets, "text_key")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int")
    sized = sized.join(sized.groupBy("kind", "run").agg(blocks.alias("blocks")), ["kind", "run"])
    mine = F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int")
    dealt = sized.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))

    def met(t: pa.Table) -> pa.Table:
        key, fp, component, mine = (np.asarray(t[c]) for c in ("text_key", "fp", "component", "mine"))
        own = [np.asarray(x.values) for x in t["shingles"]]
        size = np.array([len(x) for x in own])
        fp, up, found = fp.view(np.uint64), {c: c for c in component.tolist()}, []
        bits = 64 if t["kind"][0].as_py() == BY_BAND else most

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        for i in range(len(key)):
            near = np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= bits
            near &= np.minimum(size[i], size[i + 1 :]) >= share * np.maximum(size[i], size[i + 1 :])
            near &= (mine[i] != mine[i + 1 :]) | (t["lo"][0] == t["hi"][0])
            for j in (np.flatnonzero(near) + i + 1).tolist():
                x, y = root(int(component[i])), root(int(component[j]))
                if x == y:
                    continue
                both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if both >= share * (size[i] + size[j] - both):
                    up[max(x, y)] = min(x, y)
                    found.append((key[i], key[j]))
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.groupBy("kind", "run", "lo", "hi").applyInArrow(lambda t: met(t), "a long, b long")


def keep_one(docs: DataFrame, shingle: int = 5, most: int = 7, share: float = 0.8, nearest: int = 3, bands: int = BANDS) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id, nulls last, then text hash.

    Texts link if they have `share` or more of all their distinct shingles in common (Jaccard) and either their
    fingerprints lie at `most` or fewer bits or they share one of `bands` bands; groups are the components. Bits alone find
    a third of the pairs at 0.8, as such texts differ in ten bits or so; a band is missed by 2 in 1,000 pairs. First each
    fingerprint's `nearest` partners under a key, by one text of each fingerprint, and the first text of each band are
    compared, so no group emits all its pairs. Where a fingerprint has more partners, or texts of one fingerprint or band
    don't link, and the texts in question are of different components still, rest_alike compares the rest: `nearest` bears
    on the time alone, no link is lost.

    Of copies the row with the smallest doc_id stays; of rows with one doc_id and text any one. Null and empty texts are
    copies of each other. Rows with null or equal doc_ids fall only with their own text. An empty table gives no rows.
    All columns are kept, whatever their names.
    """
    rows = materialise(fingerprints(docs, shingle, bands=bands), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")
    keys = [F.first("bands").alias("bands")] if bands else []
    texts = materialise(rows.groupBy("text_key", "fp").agg(first, *keys), "texts")
    classes = texts.groupBy("fp").agg(F.min("text_key").alias("lead"))
    named = classes.select(F.col("fp").alias("__fp"), "lead")
    linked = materialise(links(classes, most, nearest=nearest), "links")
    pairs = linked.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    leads = pairs.join(named.select(F.col("__fp").alias("a"), F.col("lead").alias("x")), "a").join(named.select(F.col("__fp").alias("b"), F.col("lead").alias("y")), "b")
    same_fp = texts.join(classes, "fp").where("text_key <> lead").select(F.col("lead").alias("a"), F.col("text_key").alias("b"))
    edges = leads.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same_fp)
    if bands:
        banded = texts.select(F.explode("bands").alias("u"), F.col("text_key").alias("v"))
        met = banded.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # most bands are of one text and end here; a band of very many makes a large partition, which Spark splits
        shared = materialise(banded.join(met, "u").select("u", "v", "m"), "bands")
        edges = edges.unionByName(shared.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges, "candidates")
    keyed = docs.withColumn("__text_key", text_key())
    ends = edges.select(F.col("a").alias("text_key")).union(edges.select("b")).distinct()
    asked = keyed.select(F.col("__text_key").alias("text_key"), "text").join(ends, "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = materialise(shingle_sets(asked, shingle), "shingles")
    near = thinned(materialise(alike(edges, sets, share), "alike"))
    nodes = texts.select(F.col("text_key").alias("node"), F.col("text_key").alias("name"))
    groups = materialise(components(nodes, near), "groups")

    # runs with partners left out: fingerprints of a key, those around one whose texts are apart, texts of a band
    apart = F.min("component") < F.max("component")
    placed = texts.select("text_key", "fp").join(groups.withColumnRenamed("node", "text_key"), "text_key")
    split = placed.groupBy("fp").agg(apart.alias("apart")).where("apart").select(F.col("fp").alias("run"))
    around = pairs.select(F.col("a").alias("run"), F.col("b").alias("fp")).union(pairs.select("b", "a")).join(split, "run", "left_semi")
    runs = linked.where("a = b").select(F.lit(BY_KEY).alias("kind"), "run", F.col("a").alias("fp"))
    runs = runs.union(around.select(F.lit(BY_FINGERPRINT), "run", "fp")).union(split.select(F.lit(BY_FINGERPRINT), "run", "run"))
    members = runs.distinct().join(placed, "fp").select("kind", "run", "text_key", "fp", "component")
    if bands:
        members = members.unionByName(shared.select(F.lit(BY_BAND).alias("kind"), F.col("u").alias("run"), F.col("v").alias("text_key")).join(placed, "text_key"))
    members = materialise(members, "members")
    still = members.groupBy("kind", "run").agg(apart.alias("apart")).where("apart").select("kind", "run")
    rest = thinned(materialise(rest_alike(members.join(still, ["kind", "run"], "left_semi"), sets, most, share), "rest"))
    if not rest.isEmpty():
        # whole components are joined now, so only their names and the new pairs go through further rounds
        of = lambda node, name: groups.select(F.col("node").alias(node), F.col("component").alias(name))
        between = rest.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        between = materialise(between.distinct(), "between")
        names = between.select(F.col("a").alias("node")).union(between.select("b")).distinct().withColumn("name", F.col("node"))
        merged = materialise(components(names, between), "merged").select(F.col("node").alias("component"), F.col("component").alias("top"))
        groups = attach(groups, merged, ["component"], F.col("node")).select("node", F.coalesce("top", "component").alias("component"))

    first = F.min(F.struct("first", "text_key")).alias("first")
    best = texts.join(groups, texts["text_key"] == groups["node"]).groupBy("component").agg(first)
    best = best.select(F.col("first.first.doc_id").alias("__keep"), F.col("first.text_key").alias("__keep_key"))
    same = keyed["doc_id"].eqNullSafe(best["__keep"]) & (keyed["__text_key"] == best["__keep_key"])
    return keyed.join(best, same, "left_semi").dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")
