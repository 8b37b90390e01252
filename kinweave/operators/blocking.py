"""Candidate pairs: equal names, structured identifiers, phonetic codes, MinHash bands, nearest neighbours, and their union."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.metaphone import codes
from ..functions.names import phonetic_blocking_form

BUCKET_MOST, POSTING_MOST, SHARED_CODES = 500, 5000, 2
STRONG_TYPES = ("COMM", "FIN", "VEH")
#: Rows and bands of the MinHash signature: 128 permutations at a Jaccard threshold of 0.3.
ROWS, BANDS = 3, 37
#: Vectors of a block of products at most, and of one that is made so that processors don't idle, and how many of those at most.
BLOCK, SMALL_BLOCK, SPREAD = 16_384, 512, 16
#: Products that are held at once, pairs that are passed on at once, tasks of a step of blocks at most.
TILE, PAIRS, MOST_TASKS = 2_000_000, 250_000, 4000


def _run(rows: DataFrame) -> list[str]:
    """The run's column, where a table has one: rows of different runs don't meet."""
    return ["run_id"] if "run_id" in rows.columns else []


def _pairs(left: DataFrame, right: DataFrame, on: list[str], key: str) -> DataFrame:
    a, b = left.select(*on, F.col(key).alias("entity_id_a")), right.select(*on, F.col(key).alias("entity_id_b"))
    return a.join(b, on).where("entity_id_a < entity_id_b").select(*_run(left), "entity_id_a", "entity_id_b")


#: Ids of a class of entities, and of a name, that stand in a row at most, and tasks of a join of classes.
CLASS_IDS, NAME_IDS, CLASS_TASKS = 256, 2048, 256


def class_pairs(entities: DataFrame, keys: dict[str, tuple[list[str], int | None]], carry: dict[str, str] | None = None) -> DataFrame:
    """Pairs of classes of entities that agree in a key: ids_a, ids_b, blocking_methods, blocking_source, blocking_method_count and
    columns of either side (``carry`` maps an entity's column to the name before _a and _b); ``expand`` makes pairs of entities of them.

    keys: for each method the columns that must be equal and not null, and the most entities that may share them (None: any number).
    Entities with the same keys and carried columns are a class, whose ids stand in rows of about CLASS_IDS. A pair of entities comes
    once, from the first key that it agrees in, with all the methods of keys that it agrees in: pairs needn't be brought together.
    Ids (within a run, if there is one) must be unique, which ``unique_ids`` tells.
    """
    run, carry, names = _run(entities), carry or {}, list(keys)
    key = {m: F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in on]), lambda x: x), F.struct(*run, *on)) for m, (on, _) in keys.items()}
    rows = entities.select(*run, "entity_id", *[F.col(c).alias(f"c_{n}") for c, n in carry.items()], *[c.alias(f"k_{m}") for m, c in key.items()])
    for m, (_, most) in keys.items():
        if most is not None:
            fit = rows.where(F.col(f"k_{m}").isNotNull()).groupBy(f"k_{m}").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most)).select(F.col(f"k_{m}").alias("fit"))
            rows = rows.join(fit, F.col(f"k_{m}") == F.col("fit"), "left").drop(f"k_{m}").withColumnRenamed("fit", f"k_{m}")
    profile = [*run, *[f"c_{n}" for n in carry.values()], *[f"k_{m}" for m in names]]
    # A class of more than CLASS_IDS has rows by the hash of the ids, numbered from its size.
    sizes = rows.groupBy(*profile).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in profile]
    part = F.pmod(F.xxhash64("x.entity_id"), F.ceil(F.col("y.n") / CLASS_IDS))
    dealt = rows.alias("x").join(sizes.alias("y"), same).select("x.*", part.alias("part"))
    classes = dealt.groupBy(*profile, "part").agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))
    out = None
    for i, m in enumerate(names):
        side = lambda s: classes.where(F.col(f"k_{m}").isNotNull()).select(*run, F.col(f"k_{m}").alias("k"), F.col("ids").alias(f"ids_{s}"), *[F.col(f"c_{n}").alias(f"{n}_{s}") for n in carry.values()], *[F.col(f"k_{o}").alias(f"k_{o}_{s}") for o in names if o != m]).repartition(CLASS_TASKS, "k")  # noqa: E731, B023
        agree = {o: F.coalesce(F.col(f"k_{o}_a") == F.col(f"k_{o}_b"), F.lit(False)) for o in names if o != m}
        found = side("a").join(side("b").drop(*run), "k").where(F.element_at("ids_a", 1) < F.element_at("ids_b", -1))
        for o in names[:i]:
            found = found.where(~agree[o])
        methods = F.array_sort(F.array_compact(F.array(F.lit(m), *[F.when(agree[o], F.lit(o)) for o in names[i + 1 :]])))
        found = found.select(*run, "ids_a", "ids_b", *[f"{n}_{s}" for n in carry.values() for s in "ab"], methods.alias("blocking_methods"))
        out = found if out is None else out.unionByName(found)
    count = F.size("blocking_methods")
    return out.withColumns({"blocking_source": F.when(count > 1, "multi").otherwise(F.col("blocking_methods")[0]), "blocking_method_count": count.cast("tinyint")})


def expand(classes: DataFrame) -> DataFrame:
    """The pairs of entities a < b of pairs of classes, with their further columns."""
    rest = [c for c in classes.columns if c not in ("ids_a", "ids_b", "run_id")]
    first = classes.where(F.element_at("ids_a", 1) < F.element_at("ids_b", -1)).select("*", F.explode("ids_a").alias("entity_id_a"))
    return first.select("*", F.explode("ids_b").alias("entity_id_b")).where("entity_id_a < entity_id_b").select(*_run(classes), "entity_id_a", "entity_id_b", *rest)


def unique_ids(entities: DataFrame) -> bool:
    return entities.groupBy(*_run(entities), "entity_id").count().where("count > 1").isEmpty()


def exact_name_pairs(entities: DataFrame, most: int | None = BUCKET_MOST) -> DataFrame:
    """Pairs of entities with equal type and normalised name; a bucket of more than ``most`` (None: of any size is kept) is left out whole."""
    on = [*_run(entities), "type", "normalized"]
    named = entities.where("normalized is not null and normalized <> ''").select(*on, "entity_id")
    buckets = named.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 if most is None else F.col("n").between(2, most)).drop("n")
    kept = named.join(buckets, on)
    return _pairs(kept, kept, on, "entity_id")


def structured_id_pairs(entities: DataFrame, types: tuple[str, ...] = STRONG_TYPES) -> DataFrame:
    """Pairs of equal identifiers of the strong types, without a cap."""
    on = [*_run(entities), "type", "normalized"]
    named = entities.where(F.col("type").isin(*types) & (F.col("normalized") != "")).select(*on, "entity_id")
    return _pairs(named, named, on, "entity_id")


def cross_type_names(entities: DataFrame, types: tuple[str, ...] = STRONG_TYPES) -> DataFrame:
    """Identifiers that occur with several strong types."""
    named = entities.where(F.col("type").isin(*types) & (F.col("normalized") != ""))
    return named.groupBy("normalized").agg(F.count_distinct("type").alias("n_types")).where("n_types > 1")


@F.pandas_udf(ArrayType(StringType()))
def phonetic_codes(names: pd.Series) -> pd.Series:
    return names.map(lambda n: sorted(codes(n or "")))


def shared_code_pairs(index: DataFrame, least: int = SHARED_CODES, most: int = POSTING_MOST) -> DataFrame:
    """Pairs (of entity_id) that share at least ``least`` codes of an index (code, entity_id); longer lists than ``most`` are skipped."""
    index = index.distinct()
    kept = index.join(index.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most)).select("code"), "code")
    return _pairs(kept, kept, ["code"], "entity_id").groupBy("entity_id_a", "entity_id_b").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= least)


def phonetic_pairs(entities: DataFrame, least: int = SHARED_CODES, most: int = POSTING_MOST, codes_of: Column | None = None) -> DataFrame:
    found = phonetic_codes(phonetic_blocking_form(F.coalesce("normalized", F.lit("")))) if codes_of is None else codes_of
    return shared_code_pairs(entities.select("entity_id", F.explode(found).alias("code")), least, most)


def shingles(name: Column) -> Column:
    """Words and character trigrams of a name."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: F.length(w) > 0)
    grams = F.when(F.length(name) >= 3, F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substring(name, i, 3))).otherwise(F.array().cast("array<string>"))
    return F.array_union(words, grams)


def _name_pairs(entities: DataFrame, close: DataFrame) -> DataFrame:
    """entity_id_a < entity_id_b, each pair once, of entities whose names are a pair (x, y) of ``close``, which has both ways and each
    name with itself. Ids of a name stand in rows of about NAME_IDS; those of a pair of names are expanded where they meet."""
    named = entities.select("entity_id", F.coalesce("normalized", F.lit("")).alias("x"))
    if unique_ids(entities):
        wanted = close.select("x").distinct()
        sizes = named.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / NAME_IDS).alias("parts")).join(wanted, "x", "left_semi")
        classes = named.join(sizes, "x").groupBy("x", F.pmod(F.xxhash64("entity_id"), F.col("parts")).alias("part"), "parts").agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))
        # A row of each pair of names for each part of the first, so that a hot pair of names is spread over many tasks.
        pairs = close.join(sizes, "x").select("x", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        left = pairs.join(classes.select("x", "part", F.col("ids").alias("ids_a")), ["x", "part"]).select("y", "ids_a")
        dealt = left.join(sizes.toDF("y", "parts"), "y").select("ids_a", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        met = dealt.join(classes.select(F.col("x").alias("y"), "part", F.col("ids").alias("ids_b")), ["y", "part"]).where(F.element_at("ids_a", 1) < F.element_at("ids_b", -1))
        return expand(met.select("ids_a", "ids_b").repartition(CLASS_TASKS, F.xxhash64("ids_a", "ids_b")))
    a, b = named.toDF("entity_id_a", "x"), named.toDF("entity_id_b", "y")
    return a.join(close, "x").join(b, "y").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")


def minhash_pairs(entities: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Pairs that share a band of a MinHash signature over words and trigrams; nothing is verified.

    The signature is built from native hash expressions: each permutation is the minimum of the shingles' hashes with a seed. It is
    that of a name: names meet by their bands, and entities only by pairs of names, once.
    """
    shingled = entities.select(F.coalesce("normalized", F.lit("")).alias("entity_id")).distinct().withColumn("s", shingles(F.col("entity_id"))).where(F.size("s") > 0)
    smallest = lambda seed: F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(seed))))
    band = lambda b: F.struct(F.lit(b).alias("band"), F.xxhash64(*[smallest(b * rows + r) for r in range(rows)]).alias("value"))
    banded = shingled.select("entity_id", F.explode(F.array(*[band(b) for b in range(bands)])).alias("b")).select("entity_id", "b.band", "b.value")
    x, y = (banded.select("band", "value", F.col("entity_id").alias(c)) for c in "xy")
    close = x.join(y, ["band", "value"]).select("x", "y").distinct()
    found = _name_pairs(entities, close)
    return found if unique_ids(entities) else found.distinct()


def jaccard_pairs(entities: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs of names with a Jaccard similarity of shingles from ``threshold`` on, exactly, over distinct names."""
    names = entities.where("normalized <> ''").select("normalized").distinct().select("normalized", shingles(F.col("normalized")).alias("s"))
    posts = names.select(F.col("normalized").alias("x"), F.explode("s").alias("g"), F.size("s").alias("nx"))
    other = posts.toDF("y", "g", "ny")
    close = posts.join(other, "g").groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold * (F.col("nx") + F.col("ny") - F.col("n"))).select("x", "y")
    return _name_pairs(entities.where("normalized <> ''"), close)


def _cells(vectors: DataFrame, key: str, vector: str, block: int, on: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """l, r, same: blocks of (id, v, further columns) beside each other, each pair of a group's blocks once, a block beside itself too.

    A group's rows (all rows without ``on``; rows with a null in it have no group) are dealt by the hash of their key into blocks of
    about ``block``, more where that leaves processors idle. Each row is sent once for each block of its group, and a task holds one
    pair of blocks at a time.
    """
    parts = lambda n: F.greatest(F.ceil(n / block), F.least(F.ceil(n / SMALL_BLOCK), F.lit(SPREAD)), F.lit(1)).cast("int")
    rows = vectors.where(F.lit(True)) if not on else vectors.dropna(subset=list(on))
    sizes = rows.groupBy(*on).agg(parts(F.count(F.lit(1))).alias("parts"))
    counted = sizes.agg(F.sum(F.col("parts") * (F.col("parts") + 1) / 2).alias("cells"), F.max("parts").alias("parts")).first()
    tasks = int(min(counted.cells or 1, MOST_TASKS))
    sized = rows.join(sizes, list(on)) if on else rows.withColumn("parts", F.lit(counted.parts))
    dealt = sized.select(*on, "parts", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("block"), F.struct(F.col(key).alias("id"), F.col(vector).alias("v"), *more).alias("x"))
    blocks = dealt.groupBy(*on, "parts", "block").agg(F.collect_list("x").alias("xs"))
    place = [*on, "i", "j"]
    left = blocks.select(*on, F.col("xs").alias("l"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("parts") - 1)).alias("j"))
    right = blocks.select(*on, F.col("xs").alias("r"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    return left.repartition(tasks, *place).join(right.repartition(tasks, *place).hint("merge"), place).select("l", "r", (F.col("i") == F.col("j")).alias("same"))


def _matrix(v: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows (padded with zeros), how many numbers each has, and which are null or hold a null."""
    sizes = np.asarray(pc.fill_null(v.value_lengths(), 0))
    flat, wide = v.flatten(), int(sizes.max(initial=0))
    gone = np.asarray(v.is_null())
    if flat.null_count:
        gone = gone.copy()
        gone[np.repeat(np.arange(len(v)), sizes)[np.asarray(flat.is_null())]] = True
        flat = pc.fill_null(flat, 0)
    flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == wide).all():
        return flat.reshape(len(v), wide), sizes, gone
    out = np.zeros((len(v), wide))
    out[np.arange(wide) < sizes[:, None]] = flat
    return out, sizes, gone


def _products(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Each pair of blocks: structs, vectors and their other marks on either side, and whether both are one block."""
    for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2)):
        l, r = left.values, right.values
        yield l, r, _matrix(l.field(1)), _matrix(r.field(1)), same.as_py()


def _apart(x: tuple, y: tuple, rows: slice) -> np.ndarray | None:
    """Which pairs have no product: a vector is missing, or the lengths differ. None: all have one."""
    (_, nx, gx), (_, ny, gy) = x, y
    sizes = np.union1d(nx, ny)
    return gx[rows, None] | gy | (nx[rows, None] != ny) if len(sizes) > 1 or gx.any() or gy.any() else None


def _wide(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' vectors, of one width."""
    wide = max(x[0].shape[1], y[0].shape[1])
    return tuple(m if m.shape[1] == wide else np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x[0], y[0]))


def _best(u: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, similarity of each row of u and its k + 1 best rows of w by the product to 6 digits, then by place; a tile at a time."""
    found = []
    step, some = max(1, TILE // max(1, len(w))), max(2048, 4 * k)
    for at in range(0, len(u), step):
        p = u[at : at + step] @ w.T
        low = np.full(len(p), -np.inf)
        if p.shape[1] > some:  # k + 1 of some columns already bound the k + 1 best of all
            low = np.partition(p[:, :some], some - k - 1, axis=1)[:, some - k - 1] - 2e-6
        i, j = np.nonzero(p >= low[:, None])
        sims = np.round(p[i, j], 6)
        order = np.lexsort((j, -sims, i))
        i, j, sims = i[order], j[order], sims[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((at + i[rank <= k], j[rank <= k], sims[rank <= k]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest_neighbours(vectors: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """query, neighbour, similarity, rank: the k vectors with the largest dot product, exactly; ties go to the smaller key.

    Blocks of vectors meet pairwise by their numbers, each passes on its k best for each query, and a window picks the k best of
    those. No vector is broadcast, and products are held a tile at a time. Similarities are compared to 6 digits. The products grow
    with the square of the rows: see ``indexed_neighbours`` for many. Rows without a vector are left out.
    """
    pairs = _cells(vectors.where(F.col(vector).isNotNull()), key, vector, block)
    kind = vectors.schema[key].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, r, x, y, same in _products(batch):
                for (s, u), (t, w) in (((l, x), (r, y)), ((r, y), (l, x)))[: 1 if same else 2]:
                    names = t.field(0)
                    order = np.argsort(np.array(names.to_pylist()), kind="stable")
                    i, j, sims = _best(u[0], w[0][order], k)
                    yield pa.RecordBatch.from_arrays([s.field(0).take(pa.array(i)), names.take(pa.array(order[j])), pa.array(sims)], ["query", "neighbour", "similarity"])

    found = pairs.mapInArrow(best, f"query {kind}, neighbour {kind}, similarity double").where("query <> neighbour")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_vectors(vectors: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK, more: tuple[str, ...] = ()) -> DataFrame:
    """a, b, score of all pairs a < b with a dot product (to 6 digits) of at least ``threshold``, each once; further columns ``more``
    of either side come as column_a and column_b, so that pairs needn't be joined to them.

    Single precision, with a margin for its error, says which pairs may reach the threshold; double precision decides.
    """
    pairs = _cells(vectors.where(F.col(vector).isNotNull()), key, vector, block, more=more)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (key, *more)}

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, r, x, y, same in _products(batch):
                u, w = _wide(x, y)
                with np.errstate(all="ignore"):
                    u4, w4 = u.astype(np.float32), w.astype(np.float32)
                    margin = 1e-6 + 4e-7 * (u.shape[1] + 4) * np.sqrt((u * u).sum(axis=1).max(initial=0) * (w * w).sum(axis=1).max(initial=0))
                parts = [z.field(0) for z in (l, r)]
                again = any(len(p.unique()) < len(p) for p in parts)  # repeated keys: their pairs count once
                kept = []
                step = max(1, TILE // max(1, len(w)))
                for at in range(0, len(u), step):
                    rows = slice(at, at + step)
                    i, j = np.nonzero(~(u4[rows] @ w4.T < threshold - margin))
                    i += at
                    if same:
                        i, j = i[i < j], j[i < j]
                        if again:  # one way round for rows of equal keys
                            code = parts[0].dictionary_encode().indices.to_numpy()
                            turn = code[i] > code[j]
                            i, j = np.where(turn, j, i), np.where(turn, i, j)
                    for low in range(0, len(i), PAIRS):
                        p, q = i[low : low + PAIRS], j[low : low + PAIRS]
                        sims = np.round(np.einsum("ij,ij->i", u[p], w[q]), 6)
                        on = (sims >= threshold) & (x[1][p] == y[1][q]) & ~x[2][p] & ~y[2][q]
                        p, q = pa.array(p[on]), pa.array(q[on])
                        made = pa.RecordBatch.from_arrays([z.field(c).take(t) for c in (0, *range(2, 2 + len(more))) for z, t in ((l, p), (r, q))] + [pa.array(sims[on])], names)
                        if again:
                            kept.append(made)
                        else:
                            yield made
                if kept:
                    yield from pa.Table.from_batches(kept).group_by(names).aggregate([]).select(names).to_batches(max_chunksize=PAIRS)

    names = [f"{c}_{s}" for c in ("_key", *more) for s in "ab"] + ["score"]
    schema = ", ".join([f"{c}_{s} {kinds[k]}" for c, k in (("_key", key), *((m, m) for m in more)) for s in "ab"] + ["score double"])
    found = pairs.mapInArrow(close, schema)
    turned = F.col("_key_a") > F.col("_key_b")
    sides = lambda c: [F.when(turned, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")) for s, t in ("ab", "ba")]
    out = [*(v.alias(s) for s, v in zip("ab", sides("_key"))), "score", *(v.alias(f"{c}_{s}") for c in more for s, v in zip("ab", sides(c)))]
    return found.where("_key_a <> _key_b").select(*out)


def group_cosines(vectors: DataFrame, key: str, vector: str, group: str, digits: int = 5, block: int = BLOCK) -> DataFrame:
    """a, b, cosine of all pairs a < b of a group: the dot product of unit vectors, clipped to [-1, 1], to ``digits``; null where a
    vector is missing, holds a null, or is of another length. The rows are as many as the pairs, which no step collects or shuffles."""
    pairs = _cells(vectors, key, vector, block, (group,))
    kind = vectors.schema[key].dataType.simpleString()

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, r, x, y, same in _products(batch):
                u, w = _wide(x, y)
                ids, others = l.field(0), r.field(0)
                step = max(1, PAIRS // max(1, len(w)))
                for at in range(0, len(u), step):
                    rows = slice(at, at + step)
                    sims = np.round(np.clip(u[rows] @ w.T, -1.0, 1.0), digits) + 0.0
                    none = _apart(x, y, rows)
                    i, j = np.divmod(np.arange(sims.size), sims.shape[1]) if not same else np.nonzero(np.arange(at, at + len(sims))[:, None] < np.arange(len(w)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + i)), others.take(pa.array(j)), pa.array(sims[i, j], mask=None if none is None else none[i, j])], ["a", "b", "cosine"])

    found = pairs.mapInArrow(cosines, f"a {kind}, b {kind}, cosine double")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def _centroids(vectors: DataFrame, key: str, vector: str, lists: int, sample: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by k-means over the ``sample`` rows (a documented bound) with the smallest hashes of their keys; those rows."""
    n = vectors.count()
    end = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * sample // max(n, 1))
    rows = vectors.select(F.xxhash64(key).alias("h"), F.col(vector).alias("v")).where((F.col("h") <= end) & F.col("v").isNotNull()).orderBy("h").limit(sample).collect()
    x = np.array([r.v for r in rows], np.float32).reshape(len(rows), -1)
    if not len(x):
        return np.zeros((0, 0), np.float32), x
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    own = x[np.random.default_rng(7).permutation(len(x))[:lists]]
    for _ in range(rounds):
        nearest = np.argmax(x @ own.T, axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(size > 0, sums / np.maximum(size, 1e-12), own).astype(np.float32)
    return own, x


def _probes(centre: np.ndarray, x: np.ndarray, k: int, recall: float, queries: int = 500) -> int:
    """Lists to look in so that ``recall`` of the k nearest of some of the sample's rows are found, by the sample itself."""
    if len(x) <= k:
        return max(1, len(centre))
    asked = np.random.default_rng(11).permutation(len(x))[:queries]
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -2
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    place = np.empty((len(asked), len(centre)), np.int64)
    np.put_along_axis(place, np.argsort(-(x[asked] @ centre.T), axis=1, kind="stable"), np.arange(len(centre))[None, :], 1)
    needed = np.sort(np.take_along_axis(place, np.argmax(x @ centre.T, axis=1)[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def indexed_neighbours(vectors: DataFrame, key: str, vector: str, k: int, lists: int | None = None, recall: float = 0.95, sample: int = 20_000, block: int = BLOCK) -> DataFrame:
    """query, neighbour, similarity, rank as ``nearest_neighbours``, by an inverted file: approximate, every row indexed.

    Centroids come from a bounded sample; each vector stands in the list of its nearest centroid and is looked up in as many of the
    nearest lists as the sample's own neighbours need for ``recall``: few where vectors form groups, most where they are noise. A
    list's members and its queries meet in blocks of about ``block``, so a list may hold any share of the rows.
    The number of lists grows with the square root of the rows (at most 16,384: the centroids are broadcast).
    """
    n = vectors.count()
    lists = lists or int(min(16_384, max(1, round(np.sqrt(n)))))
    centre, known = _centroids(vectors, key, vector, lists, sample)
    probes = _probes(centre, known, k, recall)
    sent = vectors.sparkSession.sparkContext.broadcast(centre)
    kind, v_kind = (vectors.schema[c].dataType.simpleString() for c in (key, vector))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float32).reshape(batch.num_rows, -1)
            near = np.argsort(-(x @ sent.value.T), axis=1, kind="stable")[:, :probes] if batch.num_rows else np.zeros((0, 1), int)
            take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            home = np.zeros(near.shape, bool)
            home[:, 0] = True
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(near.ravel().astype(np.int32)), pa.array(home.ravel())], ["id", "v", "list", "home"])

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    placed = rows.mapInArrow(place, f"id {kind}, v {v_kind}, list int, home boolean")
    parts = placed.groupBy("list").agg(F.ceil(F.count_if("home") / block).cast("int").alias("members"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("asked"))
    sized = placed.join(parts, "list").where("members > 0")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    members = sized.where("home").select("id", "v", "list", part("members").alias("m"), spread("asked").alias("q"), F.lit(True).alias("home"))
    asked = sized.select("id", "v", "list", spread("members").alias("m"), part("asked").alias("q"), F.lit(False).alias("home"))

    def best(key_: tuple, table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        ids = table.column("id").combine_chunks()
        x = np.array(table.column("v").to_pylist(), np.float64).reshape(table.num_rows, -1)
        own, others = np.flatnonzero(~home), np.flatnonzero(home)
        names = np.array(ids.take(pa.array(others)).to_pylist())
        others = others[np.argsort(names, kind="stable")]
        sims = np.round(x[own] @ x[others].T, 6)
        top = np.argsort(-sims, axis=1, kind="stable")[:, : k + 1]
        query, other = np.repeat(own, top.shape[1]), others[top.ravel()]
        found = np.take_along_axis(sims, top, 1).ravel()
        return pa.table({"query": ids.take(pa.array(query)), "neighbour": ids.take(pa.array(other)), "similarity": pa.array(found)})

    found = members.unionByName(asked).groupBy("list", "m", "q").applyInArrow(best, f"query {kind}, neighbour {kind}, similarity double").where("query <> neighbour")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Neighbour lists as unordered pairs."""
    return neighbours.select(F.least("query", "neighbour").alias("entity_id_a"), F.greatest("query", "neighbour").alias("entity_id_b")).distinct()


def union_candidates(sources: dict[str, DataFrame], entities: DataFrame | None = None) -> DataFrame:
    """entity_id_a, entity_id_b, blocking_methods (sorted), blocking_source, blocking_method_count.

    Pairs of an entity with itself and, if entities are given, of different types are left out.
    """
    every = None
    run = ["run_id"] if all("run_id" in p.columns for p in sources.values()) else []
    for method, pairs in sources.items():
        ordered = pairs.select(*run, F.least("entity_id_a", "entity_id_b").alias("entity_id_a"), F.greatest("entity_id_a", "entity_id_b").alias("entity_id_b"), F.lit(method).alias("method"))
        every = ordered if every is None else every.unionByName(ordered)
    found = every.where("entity_id_a < entity_id_b").groupBy(*run, "entity_id_a", "entity_id_b").agg(F.array_sort(F.collect_set("method")).alias("blocking_methods"))
    if entities is not None:
        types = entities.select(*run, "entity_id", "type")
        found = found.join(types.toDF(*run, "entity_id_a", "type_a"), [*run, "entity_id_a"], "left").join(types.toDF(*run, "entity_id_b", "type_b"), [*run, "entity_id_b"], "left").where("type_a <=> type_b").drop("type_a", "type_b")
    count = F.size("blocking_methods")
    return found.select(*run, "entity_id_a", "entity_id_b", "blocking_methods", F.when(count > 1, "multi").otherwise(F.col("blocking_methods")[0]).alias("blocking_source"), count.cast("tinyint").alias("blocking_method_count"))


def with_entities(pairs: DataFrame, entities: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pairs with columns of either entity: columns maps an entity's column to the name before _a and _b. Where both tables have a
    run_id, entities are those of the pair's run."""
    run = _run(pairs) if _run(entities) else []
    for s in "ab":
        side = entities.select(*run, F.col("entity_id").alias(f"entity_id_{s}"), *[F.col(c).alias(f"{n}_{s}") for c, n in columns.items()])
        pairs = pairs.join(side, [*run, f"entity_id_{s}"])
    return pairs
