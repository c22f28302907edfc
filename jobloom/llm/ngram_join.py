"""N-gram Jaccard join with several global token orders.

Under any order of all shingles, two sets with Jaccard similarity t share an element among
the first |x| - ceil(t|x|) + 1 of each. Orders here start with the shingles that one
document alone holds; those make no candidates, so only a document whose prefix reaches
its shared shingles has candidates at all. The first order goes on with the rarest shared
shingles and makes the candidate pairs; a pair is verified only if it shares prefix
elements under two more orders (by hash, upwards and downwards) as well.

Equal sets are joined as one class first. The result is one row per document with the
smallest id that links lead to. The classes of a prefix element that many of them hold are
first tried against a few hubs. What is linked so far needs no further pairs; classes that
are still apart are then held against the others block by block. No link between
components is lost, and no task gets more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, hot_keys, hot_rows, importable, materialise, split_join, table
from .components import connected_components
from .shingles import hash_words, mix, shingle_sets, text_steps

WORDS, PERCENT = 5, 75
#: Shingles packed together by one task, and documents (their places take 16 bits).
CHUNK, CHUNK_DOCS = 1_500_000, 60_000
#: Shingles counted together in one group, on average.
BUCKET = 750_000
#: A shingle in more documents of a chunk than this is counted in the chunk first.
HEAVY = 64
#: Prefix elements of up to so many classes make all their pairs at once; beyond, hubs come first.
SMALL, HUBS = 8, 3
#: Sets, and shingles of sets, on each side of a block of pairs that one task verifies.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000

_KEY = np.uint64((1 << 48) - 1)
_PACKED = "bucket int, chunk long, keys binary, docs binary, heavy binary, heavy_n binary, ids array<long>, sizes binary, prints binary, own binary, own_n binary, own_docs binary"
_COUNTED = "bucket int, chunk long, keys binary, docs binary, dfs binary, heavy binary, heavy_dfs binary, ids array<long>, sizes binary, prints binary, own binary, own_n binary, own_docs binary"
_PROFILE = "doc_id long, n long, print binary, k int, shared array<long>, rare array<long>"


def _narrow(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)


def _pack_chunk(chunk: int, held: list, buckets: int) -> pa.RecordBatch:
    """One row per bucket with the chunk's shingles, and one row with its documents."""
    ids = pa.concat_arrays([x[0] for x in held])
    sizes = np.concatenate([x[1] for x in held])
    prints = np.concatenate([x[2] for x in held])
    shift = np.cumsum([0, *(len(x[1]) for x in held[:-1])])
    docs = np.concatenate([x[3] + s for x, s in zip(held, shift, strict=True)]).astype("<u2")
    hashes = np.concatenate([x[4] for x in held])
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    begin = _runs(hashes)
    count = np.diff(np.append(begin, len(hashes)))
    heavy = np.repeat(count > HEAVY, count)
    own, own_n = hashes[begin][count > HEAVY], count[count > HEAVY].astype("<u4")
    own_docs, hashes, docs = docs[heavy], hashes[~heavy], docs[~heavy]
    of, own_of = _bucket(hashes, buckets), _bucket(own, buckets)
    used = np.union1d(of[_runs(of)], own_of[_runs(own_of)])
    cut, own_cut = ((np.searchsorted(x, used), np.searchsorted(x, used, "right")) for x in (of, own_of))
    keys, docs, own_keys, own_n_raw = _narrow(hashes), docs.tobytes(), _narrow(own), own_n.tobytes()
    rows: dict[str, list] = {x.split()[0]: [] for x in _PACKED.split(", ")}

    def add(**values) -> None:
        for name, column in rows.items():
            column.append(values.get(name))

    for b, i, j, k, m in zip(used.tolist(), *(x.tolist() for x in (*cut, *own_cut)), strict=True):
        add(bucket=b, chunk=chunk, keys=keys[6 * i : 6 * j], docs=docs[2 * i : 2 * j], heavy=own_keys[6 * k : 6 * m], heavy_n=own_n_raw[4 * k : 4 * m])
    add(bucket=chunk % buckets, chunk=chunk, ids=ids.to_pylist(), sizes=sizes.astype("<i8").tobytes(), prints=prints.tobytes(), own=own.astype("<u8").tobytes(), own_n=own_n_raw, own_docs=own_docs.tobytes())
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "ids": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()], names=list(rows))


def _prints(sizes: np.ndarray, texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """128 bits for each set: two sums of differently mixed elements."""
    out = np.zeros((len(sizes), 2), "<u8")
    full = np.flatnonzero(sizes)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        out[full, 0] = np.add.reduceat(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), begin)
        out[full, 1] = np.add.reduceat(mix(hashes + np.uint64(0xE7037ED1A0B428DB)), begin)
    return out


def _pack(words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, tokens, docs = TaskContext.get().partitionId() << 24, [], 0, 0
        for batch in batches:
            for step in text_steps(batch):
                sizes, texts, hashes = shingle_sets(hash_words(step.column(1)), words)
                if held and (tokens + len(hashes) > CHUNK or docs + len(sizes) > CHUNK_DOCS):
                    yield _pack_chunk(chunk, held, buckets)
                    chunk, held, tokens, docs = chunk + 1, [], 0, 0
                for a in range(0, len(sizes), CHUNK_DOCS):  # many tiny texts in one step
                    b = min(len(sizes), a + CHUNK_DOCS)
                    inside = slice(*np.searchsorted(texts, [a, b]))
                    held.append((step.column(0).slice(a, b - a), sizes[a:b], _prints(sizes[a:b], texts[inside] - a, hashes[inside]), texts[inside] - a, hashes[inside]))
                    if b < len(sizes):
                        yield _pack_chunk(chunk, held, buckets)
                        chunk, held = chunk + 1, []
                tokens, docs = sum(len(x[4]) for x in held), sum(len(x[1]) for x in held)
        if held:
            yield _pack_chunk(chunk, held, buckets)

    return run


def _count(rows: pa.Table) -> pa.Table:
    """For one bucket: the document frequency of each shingle that two documents hold, sent back to the chunks."""
    column = {x: rows.column(x).to_pylist() for x in ("keys", "docs", "heavy", "heavy_n")}
    keys = [_wide(x or b"") for x in column["keys"]]
    heavy = [_wide(x or b"") for x in column["heavy"]]
    every = np.concatenate([*keys, *heavy])
    weight = np.concatenate([np.ones(sum(map(len, keys)), np.int64), *(np.frombuffer(x or b"", "<u4").astype(np.int64) for x in column["heavy_n"])])
    df = np.empty(len(every), np.int64)
    if len(every):
        order = np.argsort(every, kind="stable")
        begin = _runs(every[order])
        df[order] = np.repeat(np.add.reduceat(weight[order], begin), np.diff(np.append(begin, len(every))))
    df = np.minimum(df, 0xFFFFFFFF).astype("<u4")
    out: dict[str, list] = {x: [] for x in ("keys", "docs", "dfs", "heavy", "heavy_dfs")}
    at, heavy_at = 0, sum(map(len, keys))
    for key, docs, many in zip(keys, column["docs"], heavy, strict=True):
        own = df[at : at + len(key)]
        again = own > 1
        out["keys"].append(_narrow(key[again]))
        out["docs"].append(np.frombuffer(docs or b"", "<u2")[again].tobytes())
        out["dfs"].append(own[again].tobytes())
        out["heavy"].append(_narrow(many))
        out["heavy_dfs"].append(df[heavy_at : heavy_at + len(many)].tobytes())
        at, heavy_at = at + len(key), heavy_at + len(many)
    names = [x.split()[0] for x in _COUNTED.split(", ")]
    return pa.table([pa.array(out[x], pa.binary()) if x in out else rows.column(x) for x in names], names=names)


def _lists(values: np.ndarray, counts: np.ndarray, there: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype("<i4")
    mask = pa.array(~there)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)), mask=mask)


def _assemble(percent: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        """For one chunk: each document's size, fingerprint, shared shingles and rarest-first prefix."""
        bucket = rows.column("bucket").to_pylist()
        column = {x: rows.column(x).to_pylist() for x in ("keys", "docs", "dfs", "heavy", "heavy_dfs", "sizes", "prints", "own", "own_n", "own_docs")}
        info = next(i for i, x in enumerate(column["sizes"]) if x is not None)
        ids = rows.column("ids").combine_chunks()[info].values
        sizes = np.frombuffer(column["sizes"][info], "<i8")
        name = lambda key, b: key | (np.uint64(b & 0x7FFF) << np.uint64(48))
        tokens = [name(_wide(x), b) for x, b in zip(column["keys"], bucket, strict=True)]
        docs = [np.frombuffer(x, "<u2") for x in column["docs"]]
        dfs = [np.frombuffer(x, "<u4") for x in column["dfs"]]
        own = np.frombuffer(column["own"][info], "<u8")
        if len(own):
            own = name(own & _KEY, 0) | ((_bucket(own, buckets) & np.uint64(0x7FFF)) << np.uint64(48))
            many = np.concatenate([name(_wide(x), b) for x, b in zip(column["heavy"], bucket, strict=True)])
            many_df = np.concatenate([np.frombuffer(x, "<u4") for x in column["heavy_dfs"]])
            order = np.argsort(many)
            own_n = np.frombuffer(column["own_n"][info], "<u4")
            own_df = many_df[order][np.searchsorted(many[order], own)]
            tokens.append(np.repeat(own, own_n))
            docs.append(np.frombuffer(column["own_docs"][info], "<u2"))
            dfs.append(np.repeat(own_df, own_n))
        tokens, docs, dfs = np.concatenate(tokens), np.concatenate(docs).astype(np.int64), np.concatenate(dfs)
        n_shared = np.bincount(docs, minlength=len(sizes))
        # The prefix is that long; shingles of one document alone come first in every order.
        k = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1 - (sizes - n_shared), 0)
        there = k > 0
        keep = there[docs]
        tokens, docs, dfs = tokens[keep], docs[keep], dfs[keep]
        n_shared = np.where(there, n_shared, 0)
        shared = tokens[np.lexsort((tokens, docs))]
        order = np.lexsort((tokens, dfs, docs))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(n_shared) - n_shared, n_shared)
        rare = tokens[order][rank < np.repeat(k, n_shared)] if len(order) else tokens
        prints = column["prints"][info]
        return pa.table(
            [
                ids,
                pa.array(sizes),
                pa.array([prints[16 * i : 16 * i + 16] for i in range(len(sizes))], pa.binary()),
                pa.array(np.maximum(k, 0).astype(np.int32)),
                _lists(shared, n_shared, there),
                _lists(rare, np.where(there, k, 0), there),
            ],
            names=[x.split()[0] for x in _PROFILE.split(", ")],
        )

    return run


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, set size ``n``, fingerprint of the set, and for rows that can
    link at all the length ``k`` of the prefix in the shared shingles, these, and the k rarest.

    Shingles travel packed: a chunk of documents sends each bucket of the hash range its
    part, which answers with the frequencies of the shingles that occur elsewhere.
    """
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # A shingle takes six bytes of text or more, but for short words.
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 6 / BUCKET))
    packed = texts.mapInArrow(_pack(words, buckets), _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count, _COUNTED)
    return materialise(counted.groupBy("chunk").applyInArrow(_assemble(percent, buckets), _PROFILE), "ngram-profiles")


def _candidate_sets(profile: DataFrame) -> DataFrame:
    """One row per distinct set that can link: its representative, and what verification needs."""
    there = profile.where(F.col("k") > 0).where(F.col("doc_id").isNotNull())
    first = [F.first(x).alias(x) for x in ("n", "k", "shared", "rare")]
    return materialise(there.groupBy("print").agg(F.min("doc_id").alias("rep"), *first).drop("print"), "ngram-candidates")


def _fits(x: Column, y: Column, percent: int) -> Column:
    """Sizes of two sets that can link."""
    return (F.least(x, y) * 100) >= (F.greatest(x, y) * percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (a, b), those that link. First the prefixes under the two orders by hash must meet."""
    side = lambda c: sets.select(F.col("rep").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "k", "shared")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    upwards = F.arrays_overlap(*(F.slice(f"shared_{c}", F.lit(1), F.col(f"k_{c}")) for c in "ab"))
    downwards = F.arrays_overlap(*(F.slice(f"shared_{c}", -F.col(f"k_{c}"), F.col(f"k_{c}")) for c in "ab"))
    common = F.size(F.array_intersect("shared_a", "shared_b"))
    return both.where(upwards & downwards).where(common * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def _pairs(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def set_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rep, component): components of the sets under "Jaccard similarity of at least percent"."""
    posts = sets.select("rep", "n", F.explode("rare").alias("token"))
    limit = hot_rows(sets.sparkSession, sets.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0])
    hub = lambda r: F.min(F.struct(F.xxhash64("rep", F.lit(r)).alias("h"), "rep", "n"))
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("m"), *(hub(r).alias(f"hub{r}") for r in range(HUBS))).where("m > 1")
    lists = materialise(lists, "ngram-lists")
    hot = hot_keys(lists, ["token"], "m", limit)
    posts = materialise(split_join(posts, lists, ["token"], hot), "ngram-postings")
    few, many = posts.where(F.col("m") <= SMALL), posts.where(F.col("m") > SMALL)
    other = few.select("token", F.col("rep").alias("rep2"), F.col("n").alias("n2"))
    close = few.join(other, "token").where(F.col("rep") < F.col("rep2")).where(_fits(F.col("n"), F.col("n2"), percent)).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    hubs = many.select("rep", "n", F.explode(F.array(*(F.col(f"hub{r}") for r in range(HUBS)))).alias("hub"))
    starred = hubs.where(F.col("rep") != F.col("hub.rep")).where(_fits(F.col("n"), F.col("hub.n"), percent)).select(*_pairs(F.col("rep"), F.col("hub.rep")))
    links = materialise(verified(close.unionByName(starred).distinct(), sets, percent), "ngram-links")
    found = materialise(connected_components(links), "ngram-components")
    more = _links_of_apart(many.select("token", F.col("hub0.rep").alias("hub"), "rep", "n"), hot, limit, found, sets, percent)
    known = found.where(F.col("node") != F.col("component")).select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialise(connected_components(known.unionByName(more)), "ngram-components")


def _links_of_apart(posts: DataFrame, hot: DataFrame | None, limit: int, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that some list of ``posts`` (token, hub, rep, n) still holds apart.

    Lists with one hub form a group, which holds each rep once. The reps outside the group's
    largest component are a query set against the whole group: both sides are cut into blocks
    of about BLOCK sets or BLOCK_SHINGLES shingles, and every pair of blocks is verified in a
    task of its own.
    """
    placed = posts.join(found, F.col("rep") == F.col("node"), "left").select("token", "hub", "rep", "n", F.coalesce("component", "rep").alias("component"))
    apart = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    members = materialise(split_join(placed, apart, ["token"], hot).select("hub", "rep", "n", "component").distinct(), "ngram-apart")
    by_component = members.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    sizes = by_component.groupBy("hub").agg(F.sum("c").alias("m"), F.sum("w").alias("mw"), F.max(F.struct("c", "component", "w")).alias("top"))
    blocks = lambda n, w: F.ceil(F.greatest(n / F.lit(BLOCK), w / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = sizes.select("hub", "m", blocks(F.col("m"), F.col("mw")).alias("all"), blocks(F.col("m") - F.col("top.c"), F.col("mw") - F.col("top.w")).alias("out"), F.col("top.component").alias("top"))
    sizes = materialise(sizes, "ngram-groups")
    rows = split_join(members, sizes, ["hub"], hot_keys(sizes, ["hub"], "m", limit)).select("hub", "rep", "component", "all", "out", "top")
    rows = rows.join(sets.select("rep", "n", "k", "shared"), "rep")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    what = ["hub", "rep", "component", "n", "k", "shared"]
    left = rows.where(F.col("component") != F.col("top")).select(*what, F.lit(True).alias("query"), own("out").alias("i"), every("all").alias("j"))
    right = rows.where("out > 0").select(*what, F.lit(False).alias("query"), own("all").alias("j"), every("out").alias("i"))
    return left.unionByName(right).groupBy("hub", "i", "j").applyInArrow(_verify_block(percent), "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of the left its overlap with every set of the right, through an inverted index."""
    tokens = np.concatenate(right)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(right)), [len(x) for x in right])[order]
    for x in left:
        lo = np.searchsorted(tokens, x, "left")
        size = np.searchsorted(tokens, x, "right") - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield np.bincount(owner[at], minlength=len(right))


def _verify_block(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of a block of query sets and one of sets to try: a link for each query and component that it is linked with."""
        query = rows.column("query").to_numpy()
        rep, component, n, k = (rows.column(x).to_numpy() for x in ("rep", "component", "n", "k"))
        lists = rows.column("shared").combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        shared = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        q, r = np.flatnonzero(query), np.flatnonzero(~query)
        out: tuple[list, list] = ([], [])
        if len(q) and len(r):
            first, last = ([x[:m] for x, m in zip(shared, k, strict=True)], [x[len(x) - m :] for x, m in zip(shared, k, strict=True)])
            pick = lambda sets, at: [sets[i] for i in at]
            counts = [_overlaps(pick(x, q), pick(x, r)) for x in (first, last, shared)]
            for i, upwards, downwards, common in zip(q, *counts, strict=True):
                linked = (upwards > 0) & (downwards > 0) & (common * (100 + percent) >= (n[i] + n[r]) * percent) & (component[r] != component[i])
                _, one = np.unique(component[r][linked], return_index=True)
                for j in r[linked][one]:
                    out[0].append(max(rep[i], rep[j]))
                    out[1].append(min(rep[i], rep[j]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    A document's set: distinct shingles of ``words`` words; fewer words make one shingle of
    all of them. Empty and null texts have no shingle and link with nothing; a row with a
    null id links with nothing and has a null component. Rows that repeat an id count as one
    document. Equal sets are linked. Other columns of ``docs`` are not read; an empty table
    gives no rows.
    """
    profile = profiles(docs, id_col, text_col, words, percent)
    found = set_links(_candidate_sets(profile), percent)
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    solid = profile.where(linkable).select("doc_id", "n", "print")
    # Equal texts share a print: a class may hold a large share of all rows.
    classes = solid.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    classes = materialise(classes.join(found, F.col("rep") == F.col("node"), "left").select("print", "m", F.coalesce("component", "rep").alias("component")), "ngram-classes")
    limit = hot_rows(docs.sparkSession, classes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    placed = split_join(solid, classes, ["print"], hot_keys(classes, ["print"], "m", limit)).select("doc_id", "n", "component")
    whole = placed.unionByName(profile.where(~linkable).select("doc_id", "n", F.col("doc_id").alias("component")))
    return whole.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the row with the group's smallest id.

    Rows without an id stay; of rows that repeat a kept id all stay.
    """
    member, group = fresh(docs, "member_id", "group_id")
    found = ngram_components(docs, id_col, text_col, words, percent).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(member)).distinct()
    return docs.join(found, docs[id_col].cast("long") == found[member], "left_anti")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
