"""MinHash near-dedup with sequential Bayesian verification: banded candidates, posterior pruning by batches of the
signature, exact verification of what survives, connected components."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh, mix, table, word_bounds, word_hashes, written
from .components import components, join_one

#: Members of a candidate group that one task compares; larger groups are dealt out in pairs of tiles of half as many.
GROUP = 4096
#: Shingles of a group that one task compares, likewise: long documents make smaller groups.
GROUP_SHINGLES = 8_000_000
HASHES = 200


@dataclass(frozen=True)
class Likeness:
    """Shingles of `words` words are alike from a Jaccard similarity of num / den on.

    Bands are as long as they can be while a pair right at the threshold has a common band but for one in a million; the
    signature is compared `batch` hashes at a time, and a pair is dropped when the posterior probability (uniform prior)
    of the threshold or more is below `miss`.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    batch: int = 40
    miss: float = 1e-7
    seed: int = 11

    @cached_property
    def rows(self) -> int:
        t = self.num / self.den
        return max([r for r in range(1, 33) if (1 - t**r) ** (HASHES // r) <= 1e-6], default=1)

    @property
    def bands(self) -> int:
        return HASHES // self.rows

    @cached_property
    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        return r.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, HASHES, dtype=np.uint64)

    @cached_property
    def least_matches(self) -> list[int]:
        """After each batch, the matches below which a pair is dropped."""
        s = (np.arange(20_000) + 0.5) / 20_000
        out = []
        for n in range(self.batch, HASHES + 1, self.batch):
            for m in range(n + 1):
                log = m * np.log(s) + (n - m) * np.log1p(-s)
                p = np.exp(log - log.max())
                if p[s >= self.num / self.den].sum() >= self.miss * p.sum():
                    break
            out.append(m)
        return out

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; one for the whole sequence if it is shorter than a shingle."""
        words = [t.lower().split() for t in texts]  # bytes: A-Z are lowered, and 0x09-0x0D and 0x20 split
        buf, low, high = word_bounds(b"\n".join(b" ".join(w) for w in words))
        h = word_hashes(buf, low, high)
        g = np.full(len(h), np.uint64(0x9E3779B97F4A7C15))
        for k in range(self.words):
            g[: max(0, len(h) - k)] = mix(g[: max(0, len(h) - k)] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
        out, at = [], 0
        for w in words:
            n = len(w)
            if n >= self.words:
                out.append(np.unique(g[at : at + n - self.words + 1]))
            else:
                out.append(np.frombuffer(hashlib.blake2b(b" ".join(w), digest_size=8).digest(), dtype="<u8") if n else np.zeros(0, dtype=np.uint64))
            at += n
        return out

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        a, b = self.coefficients
        low = np.full(HASHES, np.iinfo(np.uint64).max)
        for k in range(0, len(shingles), 256):
            low = np.minimum(low, ((shingles[k : k + 256, None] ^ b) * a).min(axis=0))
        return (low >> np.uint64(32)).astype(np.uint32)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        rows = signature[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
        return key.view(np.int64)


def digest_of(shingles: np.ndarray) -> bytes | None:
    """What texts with equal shingle sets share; none without words."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sketches(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of each row; digest and bands are null where the text has no words."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            n, digest, bands, k = [], [], [], 0
            while k < len(texts):
                part, held = [], 0
                while k < len(texts) and (not part or held < 1 << 20):
                    part.append(texts[k] or b"")
                    held += len(part[-1])
                    k += 1
                for s in like.sets(part):
                    n.append(len(s))
                    digest.append(digest_of(s))
                    bands.append(like.band_keys(like.signature(s)) if len(s) else None)
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def links(sets: list[np.ndarray], like: Likeness, side: np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
    """Roots of the linked members of a group, and how many pairs were candidates and survived. side: where given, only
    pairs between the two sides are compared.

    Survivors are verified in the order of their matches; pairs that are linked already, through others, need no look.
    A member with many survivors is counted against all members at once over an index of the group's shingles.
    """
    m, root = len(sets), np.arange(len(sets))
    signatures = np.stack([like.signature(s) for s in sets])
    keys = np.stack([like.band_keys(s) for s in signatures])
    candidate = np.zeros((m, m), dtype=bool)
    for column in keys.T:
        order = np.argsort(column, kind="stable")
        edge = np.concatenate(([0], np.flatnonzero(np.diff(column[order])) + 1, [m]))
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if z - a > 1:
                candidate[np.ix_(order[a:z], order[a:z])] = True
    candidate = np.triu(candidate, 1)
    if side is not None:
        candidate &= side[:, None] != side[None, :]
    i, j = np.nonzero(candidate)
    del candidate
    tried, kept = len(i), []
    for a in range(0, len(i), 20_000):
        x, y, n = i[a : a + 20_000], j[a : a + 20_000], np.zeros(min(20_000, len(i) - a), dtype=np.int32)
        for k, least in enumerate(like.least_matches):
            cols = slice(k * like.batch, (k + 1) * like.batch)
            n = n + (signatures[x, cols] == signatures[y, cols]).sum(axis=1, dtype=np.int32)
            ok = n >= least
            x, y, n = x[ok], y[ok], n[ok]
        kept.append(np.stack([x, y, n]))
    x, y, n = np.concatenate(kept, axis=1) if kept else np.zeros((3, 0), dtype=np.int64)
    size = np.array([len(s) for s in sets])

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(p, q):
        p, q = find(p), find(q)
        root[max(p, q)] = min(p, q)

    order = np.argsort(-n, kind="stable")
    x, y = x[order], y[order]
    many = np.bincount(np.concatenate((x, y)), minlength=m) > 64
    rows = ids = edge = None
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        if not (many[p] or many[q]) and find(p) != find(q):
            common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if like.den * common >= like.num * (size[p] + size[q] - common):
                join(p, q)
    heavy = np.flatnonzero(many)
    if len(heavy):
        values = np.concatenate(sets)
        _, ids = np.unique(values, return_inverse=True)
        edge = np.concatenate(([0], np.cumsum(size)))
        order = np.argsort(ids, kind="stable")
        rows = np.repeat(np.arange(m), size)[order]
        posting = np.concatenate(([0], np.cumsum(np.bincount(ids))))
        partner = [set() for _ in range(m)]
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            if many[p] or many[q]:
                partner[p if many[p] else q].add(q if many[p] else p)
        for p in heavy.tolist():
            mine = ids[edge[p] : edge[p + 1]]
            common = np.bincount(np.concatenate([rows[posting[k] : posting[k + 1]] for k in mine.tolist()]), minlength=m)
            q = np.array(sorted(partner[p]), dtype=np.int64)
            for k in q[like.den * common[q] >= like.num * (size[p] + size[q] - common[q])].tolist() if len(q) else []:
                join(p, k)
    return np.array([find(k) for k in range(m)]), tried, len(x)


def verify(like: Likeness):
    def run(t: pa.Table) -> pa.Table:
        seen: dict[tuple, tuple] = {}
        rows = list(zip(*(t.column(c).to_pylist() for c in ("node", "digest", "text", "tile")), strict=True))
        for (doc, digest, text, tile), s in zip(rows, like.sets([r[2] or b"" for r in rows]), strict=True):
            if digest_of(s) == digest:  # an id may have other texts, which aren't of this class
                seen.setdefault((doc, digest), (s, tile))
        order = sorted(seen)
        ids = [k[0] for k in order]
        first, second = t.column("first")[0].as_py(), t.column("second")[0].as_py()
        side = np.array([seen[k][1] != first for k in order]) if first != second else None
        root, _, _ = links([seen[k][0] for k in order], like, side)
        return pa.table({"u": pa.array(ids, pa.int64()), "v": pa.array([ids[k] for k in root.tolist()], pa.int64())})

    return run


def classes(docs: DataFrame, like: Likeness, group: int = GROUP, shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Documents with equal shingle sets are one class, known by its smallest id: only that one is banded and compared.
    Members of a band are tied to the smallest of them, and what hangs together is a candidate group, whose members are
    sent to one task (large groups: to one for each pair of tiles), so pairs are never rows. Texts without words are
    linked with nothing; rows with the same id count as one document, which is linked with what any of its texts is linked
    with; a null id is kept and linked with nothing.
    """
    known = written(sketches(docs, like), "sketches")
    # written, so that what joins it meets a plain exchange, which is split where one class has very many documents
    reps = written(known.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")), "classes")
    bands = reps.select("rep", F.explode("bands").alias("key"))
    leaders = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).filter("leader < last").select("key", "leader", "n")
    near = components(join_one(bands, leaders, "key", like.bands * reps.count()).filter("rep <> leader").select(F.col("leader").alias("u"), F.col("rep").alias("v")))
    members = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct()).join(reps.select(F.col("rep").alias("node"), "digest", "size"), "node")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    members = members.join(sizes, "component")
    whole = (F.col("n") <= group) & (F.col("total") <= shingles)
    tiles = F.greatest(F.ceil(F.col("n") / (group // 2)), F.ceil(F.col("total") / (shingles // 2)))
    members = members.withColumn("tiles", F.when(whole, F.lit(1)).otherwise(F.least(tiles, F.col("n"))).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("component", "node", "digest", "tile", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").cast("binary").alias("text"))
    # texts always meet their members by a shuffle: at any size but a tiny one the members are too many to broadcast
    found = members.join(texts.hint("merge"), "node").groupBy("component", "first", "second").applyInArrow(verify(like), "u long, v long")
    # ids with several texts, of which there are none in most tables: their classes are linked through the id
    several = known.filter("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.bool_or(F.col("digest").isNull()).alias("blank")).filter("low < high or (low is not null and blank)").select("doc_id")
    classed = known.select("doc_id", "digest").join(written(several, "several"), "doc_id").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    owners = written(classed.groupBy("doc_id").agg(F.min("rep").alias("owner"), F.collect_set("rep").alias("reps")), "owners")
    linked = components(found.unionByName(owners.select(F.col("owner").alias("u"), F.explode("reps").alias("v"))))
    class_of = known.join(reps.select(F.col("digest").alias("d"), "rep"), F.col("digest") == F.col("d"), "left").join(owners.select("doc_id", "owner"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("rep", "owner").alias("rep"))
    out = class_of.join(linked, F.col("rep") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, like: Likeness | None = None) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, with all rows that have this id. Columns of
    docs, whatever their names."""
    (key,) = fresh(docs, "kept_id")
    kept = classes(docs.select("doc_id", "text"), like or Likeness()).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.hint("merge").join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[key]), "left_semi")


def op7(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), Likeness(words=3, num=85))
