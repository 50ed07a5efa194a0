"""Merkle manifest of a dataset: a tree of every group's rows, a tree of the groups' roots, and a proof for every row.

A leaf is the SHA-256 of a row's fields; every eight consecutive nodes of a level, the last ones being fewer, become their hash until
one is left. Leaves are sorted by range into the partitions of a checkpointed table, and one count of each group in each partition
says where every partition's leaves stand in their group (`Place`). Then

1. each partition builds all aligned subtrees that lie in it wholly, and hands on the few ragged nodes at its ends (at most seven at
   either end of each level) with their coordinates (group, level, index),
2. these are shuffled by the coordinate of their parent, level by level, until each group has its root,
3. on the way down each ragged node gets its siblings up to the root, and goes back to its partition,
4. where every leaf takes its siblings below from the partition, and those above from the ragged node over it.

The groups' roots are the leaves of one more such tree. A group is in as many partitions as it needs, so none is too large, and
there may be as many groups as rows. The driver holds two numbers for each partition. Texts are read once, for the leaves.

Defined results: null fields are hashed as such; a null group is one of its own and comes first. Empty and very long texts are leaves
like others. Leaves of a group are ordered by id, null ids first; rows of one id by their digests; repeated rows are leaves of
their own. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.llm.common import documents, scratch, stored

#: Leaves in one partition, about; a task holds the nodes of one.
LEAVES = 100_000
#: Rows of proofs that leave a task at a time.
ROWS = 2_000
PROOF = "array<struct<left:string,right:string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def hashed(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def height(total: int) -> int:
    """Levels above the leaves."""
    return max(0, -(-(total - 1).bit_length() // 3)) if total > 1 else 0


def nodes_at(level: int, total: int) -> int:
    return -(-total >> 3 * level) if level else total


class Place(NamedTuple):
    """What a partition knows of its first and its last group: leaves in earlier partitions, and leaves in all."""

    before: int
    total_first: int
    total_last: int


class Segment:
    """The nodes over the leaves a to b of a group of so many leaves that are wholly over them."""

    def __init__(self, a: int, total: int, digests: list[str]):
        self.a, self.b, self.total, self.top = a, a + len(digests), total, height(total)
        self.levels, self.first = [digests], [a]
        for level in range(self.top):
            lo, hi = self.runs(level)
            n, here, at = nodes_at(level, total), self.levels[level], self.first[level]
            self.levels.append([hashed(here[8 * r - at : min(8 * r + 8, n) - at]) for r in range(lo, hi)])
            self.first.append(lo)

    def runs(self, level: int) -> tuple[int, int]:
        """The runs of a level whose nodes are all here."""
        size = 3 * (level + 1)
        lo, hi = -(-self.a >> size), nodes_at(level + 1, self.total) if self.b == self.total else self.b >> size
        return lo, max(lo, hi)

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """(level, index, digest) of the nodes whose run is not here wholly, and of the root."""
        for level in range(self.top):
            lo, hi = self.runs(level)
            for i, d in enumerate(self.levels[level], self.first[level]):
                if not lo <= i >> 3 < hi:
                    yield level, i, d
        if self.levels[self.top]:
            yield self.top, 0, self.levels[self.top][0]

    def proofs(self, above: dict[tuple[int, int], list], tail: list) -> Iterator[list[tuple[str, str]]]:
        """The siblings (left, right) of each leaf, level by level; `above` has those of the ragged nodes."""
        last: list[tuple[int, list] | None] = [None] * (self.top + 1)
        bounds = [self.runs(level) for level in range(self.top)]

        def upward(level: int, i: int) -> list[tuple[str, str]]:
            if level == self.top:
                return tail
            if (kept := last[level]) and kept[0] == i:
                return kept[1]
            run = i >> 3
            if bounds[level][0] <= run < bounds[level][1]:
                at = self.first[level]
                here = self.levels[level][8 * run - at : min(8 * run + 8, nodes_at(level, self.total)) - at]
                out = [("".join(here[: i & 7]), "".join(here[(i & 7) + 1 :])), *upward(level + 1, run)]
            else:
                out = above[level, i] + tail
            last[level] = (i, out)
            return out

        for i in range(self.a, self.b):
            yield upward(0, i)


class Forest(NamedTuple):
    leaves: DataFrame  #: sorted and checkpointed, with their partition (pid),
    order: list[str]
    parts: int
    places: dict[int, Place]
    counts: DataFrame  #: (pid, g, n),
    roots: DataFrame  #: (g, root) of the groups,
    above: DataFrame  #: (pid, g, level, idx, proof) of the ragged nodes


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoint"))
    return df.checkpoint()


def _places(ends: list) -> dict[int, Place]:
    """From rows (pid, head, n_head, tail, n_tail) in order: counts of the first and the last group of each partition."""
    before, total = {}, {}
    for k, e in enumerate(ends):
        p = ends[k - 1] if k else None
        goes_on = p is not None and p.tail == e.head
        before[k] = (before[k - 1] if p.head == p.tail else 0) + p.n_tail if goes_on else 0
    for k in range(len(ends) - 1, -1, -1):
        e, f = ends[k], ends[k + 1] if k + 1 < len(ends) else None
        own = (before[k] if e.head == e.tail else 0) + e.n_tail
        total[k] = total[k + 1, "first"] if f is not None and f.head == e.tail else own
        total[k, "first"] = total[k] if e.head == e.tail else before[k] + e.n_head
    return {e.pid: Place(before[k], total[k, "first"], total[k]) for k, e in enumerate(ends)}


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    """Runs of equal g in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        gs, at = batch.column("g").to_pylist(), 0
        for i in range(1, len(gs) + 1):
            if i == len(gs) or gs[i] != gs[at]:
                part = batch.select(names).slice(at, i - at)
                if held and held[-1].column("g")[0].as_py() != gs[at]:
                    yield held[-1].column("g")[0].as_py(), held
                    held = []
                held.append(part)
                at = i
    if held:
        yield held[-1].column("g")[0].as_py(), held


def forest(leaves: DataFrame, order: list[str], leaves_each: int = LEAVES) -> Forest:
    """Sorts leaves (g, digest, columns of `order`, others) and builds the trees of their groups. g is a string and not null."""
    spark = leaves.sparkSession
    rows = leaves.count()
    parts = max(1, -(-rows // leaves_each), min(spark.sparkContext.defaultParallelism, rows // 1000))
    ranged = leaves.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    sorted_ = _checkpointed(ranged.withColumn("pid", F.spark_partition_id()))
    counts = stored(sorted_.groupBy("pid", "g").agg(F.count(F.lit(1)).alias("n")), "counts")
    end = lambda f: f(F.struct("g", "n"))
    ends = counts.groupBy("pid").agg(end(F.min).alias("a"), end(F.max).alias("b")).select("pid", F.sha2("a.g", 256).alias("head"), F.col("a.n").alias("n_head"), F.sha2("b.g", 256).alias("tail"), F.col("b.n").alias("n_tail"))
    places = _places(sorted(ends.collect()))  # a row for each partition
    shared = spark.sparkContext.broadcast(places)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before = None, None  # a group is built when the next one shows whether it was the last

        def built(name: str, held: list[pa.RecordBatch], first: bool, last: bool) -> pa.RecordBatch:
            digests = [d for b in held for d in b.column("digest").to_pylist()]
            place = shared.value[pid]
            a = place.before if first else 0
            segment = Segment(a, place.total_first if first else place.total_last if last else len(digests), digests)
            out = list(segment.ragged())
            level, idx, digest = zip(*out, strict=True) if out else ((), (), ())
            n = len(out)
            return pa.RecordBatch.from_arrays([pa.array([pid] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array([segment.total] * n, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(digest, pa.string())], ["pid", "g", "total", "level", "idx", "digest"])

        first = True
        for name, held in _groups(batches, ["pid", "g", "digest"]):
            if before:
                yield built(*before, first, False)
                first = False
            pid, before = held[0].column("pid")[0].as_py(), (name, held)
        if before:
            yield built(*before, first, True)

    nodes = stored(sorted_.select("pid", "g", "digest").mapInArrow(build, "pid int, g string, total long, level int, idx long, digest string"), "nodes")
    top = max((height(max(p.total_first, p.total_last)) for p in places.values()), default=0)
    above, roots = _joined(nodes, top)
    return Forest(sorted_, order, max(places, default=0) + 1, places, counts, roots, above)


def _top(total: Column) -> Column:
    """The height of a tree, as a column."""
    return sum((F.when(total > 8**k, 1).otherwise(0) for k in range(20)), F.lit(0))


def _joined(nodes: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Finishes the upper levels from ragged nodes; (pid, g, level, idx, proof) of the ragged nodes, and (g, root)."""
    nodes = nodes.withColumn("top", _top(F.col("total")))
    roots = nodes.filter("level = top").select("g", F.col("digest").alias("root"))
    runs: list[DataFrame] = []
    made: DataFrame | None = None
    for level in range(top):
        here = nodes.filter((F.col("level") == level) & (F.col("level") < F.col("top"))).select("g", "top", "idx", "digest", "pid")
        here = here.unionByName(made.filter(f"top > {level}").select("g", "top", "idx", "digest", F.lit(None).cast("int").alias("pid"))) if made is not None else here
        run = here.groupBy("g", "top", F.shiftright("idx", 3).alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "pid"))).alias("kids"))
        runs.append(run := stored(run, "runs"))
        made = run.select("g", "top", F.col("run").alias("idx"), F.sha2(F.array_join(F.transform("kids", lambda x: x["digest"]), ""), 256).alias("digest"))
        roots = roots.unionByName(made.filter(f"top = {level + 1}").select("g", F.col("digest").alias("root")))
    above = nodes.filter("false").select("pid", "g", "level", "idx", F.expr(f"cast(array() as {PROOF})").alias("proof"))
    down: DataFrame | None = None
    for level in range(top - 1, -1, -1):
        run = runs[level]
        tail = F.expr(f"cast(array() as {PROOF})")
        if down is not None:
            run = run.join(down.filter("pid is null").select("g", F.col("idx").alias("run"), F.col("proof").alias("tail")), ["g", "run"], "left")
            tail = F.coalesce("tail", tail)
        each = run.select("g", "kids", tail.alias("tail"), F.explode("kids").alias("kid"))

        def others(beside) -> Column:
            return F.array_join(F.transform(F.filter("kids", beside), lambda x: x["digest"]), "")

        step = F.struct(others(lambda x: x["idx"] < F.col("kid.idx")).alias("left"), others(lambda x: x["idx"] > F.col("kid.idx")).alias("right"))
        down = stored(each.select(F.col("kid.pid").alias("pid"), "g", F.lit(level).alias("level"), F.col("kid.idx").alias("idx"), F.concat(F.array(step), F.col("tail")).alias("proof")), "down")
        above = above.unionByName(down.filter("pid is not null"))
    return above, roots


def proved(trees: Forest, tails: DataFrame, carry: list[str]) -> DataFrame:
    """Rows (g, digest, subroot, root, proof, *carry) of all leaves; tails has (g, subroot, root, tail) of the groups."""
    leaves, order = trees.leaves, trees.order
    kept = list(dict.fromkeys([*order, *carry]))
    none = {f.name: F.lit(None).cast(f.dataType) for f in leaves.schema.fields if f.name in kept}
    blank = {"level": F.lit(None).cast("int"), "idx": F.lit(None).cast("long"), "proof": F.lit(None).cast(PROOF), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")}
    columns = ["pid", "g", "kind", "digest", *blank, *[f"_{c}" for c in kept]]

    def rows(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        values = {"pid": F.col("pid"), "g": F.col("g"), "kind": F.lit(kind), "digest": F.lit(None).cast("string"), **blank, **{f"_{c}": x for c, x in none.items()}, **given}
        return df.select(*[values[c].alias(c) for c in columns])

    groups = trees.counts.join(tails, "g")
    all_ = rows(groups, 0, proof=F.col("tail"), subroot=F.col("subroot"), root=F.col("root"))
    all_ = all_.unionByName(rows(trees.above, 1, level=F.col("level"), idx=F.col("idx"), proof=F.col("proof")))
    all_ = all_.unionByName(rows(leaves, 2, digest=F.col("digest"), **{f"_{c}": F.col(f"`{c}`") for c in kept}))
    dealt = all_.repartitionById(trees.parts, "pid").sortWithinPartitions("g", "kind", *[f"_{c}" for c in order])
    shared = leaves.sparkSession.sparkContext.broadcast(trees.places)
    out_names = ["g", "digest", "subroot", "root", "proof", *carry]
    places = [columns.index(f"_{c}") for c in carry]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch], first: bool, last: bool) -> Iterator[pa.RecordBatch]:
            name = held[0].column("g")[0].as_py()
            above, leaves_here, digests, tail, subroot, root = {}, [], [], [], None, None
            for b in held:
                kinds = b.column("kind").to_numpy()
                said = int((kinds < 2).sum())
                if said:
                    m = b.slice(0, said).select(["kind", "level", "idx", "proof", "subroot", "root"]).to_pylist()
                    for r in m:
                        proof = [(x["left"], x["right"]) for x in r["proof"]]
                        if r["kind"] == 0:
                            tail, subroot, root = proof, r["subroot"], r["root"]
                        else:
                            above[r["level"], r["idx"]] = proof
                if said < b.num_rows:
                    leaves_here.append(b.slice(said))
                    digests += leaves_here[-1].column("digest").to_pylist()
            place = shared.value[held[0].column("pid")[0].as_py()]
            segment = Segment(place.before if first else 0, place.total_first if first else place.total_last if last else len(digests), digests)
            proofs = segment.proofs(above, tail)
            for b in leaves_here:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    n = part.num_rows
                    own = [next(proofs) for _ in range(n)]
                    offsets = [0]
                    for p in own:
                        offsets.append(offsets[-1] + len(p))
                    steps = pa.StructArray.from_arrays([pa.array([x[k] for p in own for x in p], pa.string()) for k in (0, 1)], ["left", "right"])
                    fixed = [pa.array([v] * n, pa.string()) for v in (name, subroot, root)]
                    yield pa.RecordBatch.from_arrays([fixed[0], part.column("digest"), *fixed[1:], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps).cast(_PROOF), *[part.column(k) for k in places]], out_names)

        before, first = None, True
        for _, held in _groups(batches, columns):
            if before:
                yield from done(before, first, False)
                first = False
            before = held
        if before:
            yield from done(before, first, True)

    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    schema = f"g string, digest string, subroot string, root string, proof {PROOF}" + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return dealt.mapInArrow(each, schema)


def leaf(*fields: Column) -> Column:
    """The digest of a row: its fields, each with its length before it, or a dash for null."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x), F.lit(":"), x), F.lit("-")) for x in shown]), 256)


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", digest: str = "leaf", carry: tuple[str, ...] = (), leaves_each: int = LEAVES) -> DataFrame:
    """Rows (group, order, leaf, subroot, root, proof, *carry) of rows with a digest each.

    A proof is an array of (left, right), from the leaf to the root: the digests of the siblings before and after the node, run together."""
    named = F.when(F.col(f"`{group}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    columns = [named.alias("g"), F.col(f"`{order}`").alias("o"), F.col(f"`{digest}`").alias("digest"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]]
    # the number tells equal rows apart, so that many of them are no single key
    leaves = stored(rows.select(*columns).withColumn("row", F.monotonically_increasing_id()), "leaves")
    low = forest(leaves, ["o", "digest", "row"], leaves_each)
    roots = stored(low.roots, "roots")
    high = forest(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest")), ["name"], leaves_each)
    whole = high.roots.select("g", F.col("root").alias("subroot"), "root", F.expr(f"cast(array() as {PROOF})").alias("tail"))
    tails = proved(high, whole, ["name"]).select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("tail"))
    out = proved(low, stored(tails, "tails"), ["o", *[f"c{k}" for k in range(len(carry))]])
    back = F.when(F.col("g") == "", F.lit(None)).otherwise(F.substring("g", 2, 1 << 30)).alias(group)
    return out.select(back, F.col("o").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def query(spark, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars")
    own = leaf(*map(F.col, (*fields, "text")))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(*map(F.col, fields), lower))
    rows = documents(spark, sf_dir).select("doc_id", "lang", own.alias("leaf"), tampered.alias("claim"))
    out = manifest(rows, carry=("claim",))
    siblings = F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), "")
    shown = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = """list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"""


def _twin(levels: int = 8) -> str:
    """Level by level; `levels` bounds the leaves of a group by 8 to its power, far above the tables the twin is for."""

    def field(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))"
    parts = [
        f"crc AS (SELECT {_CRC} AS tab)",
        f"leaves AS (SELECT row_number() OVER () AS r, doc_id, lang, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low, "
        f"xor(list_reduce({digits}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 3 = 0 AS bad FROM documents, crc)",
        "placed AS (SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM leaves)",
        "t0 AS (SELECT g, i, leaf AS d FROM placed)",
    ]

    def climb(prefix: str) -> None:
        for k in range(levels):
            parts.append(f"{prefix}{k + 1} AS (SELECT g, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {prefix}{k} WHERE g IN (SELECT g FROM {prefix}{k} GROUP BY g HAVING count(*) > 1) GROUP BY g, i // 8)")
        parts.append(f"{prefix}_root AS (" + " UNION ALL ".join(f"SELECT g, any_value(d) AS d FROM {prefix}{k} GROUP BY g HAVING count(*) = 1" for k in range(levels + 1)) + ")")

    climb("t")
    parts.append("u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS name FROM t_root)")
    climb("u")
    parts.append("f_0 AS (SELECT p.r, p.g, p.i, u.i AS ui, CASE WHEN bad THEN low ELSE leaf END AS f, '' AS sib FROM placed p JOIN u0 u ON u.name = p.g)")
    step = 0
    for prefix, g, i in (("t", "f.g", "f.i"), ("u", "''", "f.ui")):
        for k in range(levels):
            # a run of the level: all its nodes, the own one replaced by what has been folded so far
            size = 8**k
            parts.append(
                f"f_{step + 1} AS (SELECT f.r, any_value(f.g) AS g, any_value(f.i) AS i, any_value(f.ui) AS ui, coalesce(CASE WHEN max(n.c) > 1 THEN sha256(string_agg(CASE WHEN n.i = {i} // {size} THEN f.f ELSE n.d END, '' ORDER BY n.i)) END, any_value(f.f)) AS f, "
                f"any_value(f.sib) || coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (n.i <> {i} // {size}), '') AS sib "
                f"FROM f_{step} f LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {prefix}{k}) n ON n.g = {g} AND n.i // 8 = {i} // {8 * size} GROUP BY f.r)"
            )
            step += 1
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT p.doc_id, p.leaf, s.d AS subroot, w.d AS root, sha256(f.sib) AS proof_sha256, f.f AS folded_root, f.f = w.d AS verified "
        f"FROM placed p JOIN f_{step} f USING (r) JOIN t_root s ON s.g = p.g CROSS JOIN u_root w"
    )


SQL = _twin()
