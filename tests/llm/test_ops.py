"""Every operator against brute force, and its defined results for nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from redactica.llm import chat, common, decontaminate, packing, quality, records, sharding, simhash, substring, topk, toxicity
from redactica.llm.tokens import Encoder, default_path

RNG = random.Random(11)
VOCAB = ["alpha", "Beta", "gamma,", "delta", "é", "of", "the", "x1", "zeta.", "łódź"]


def prose(n, rng=RNG, vocab=VOCAB):
    return " ".join(rng.choice(vocab) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string, n_words string, id string, score string, text_ string"):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(400)), (5, prose(400)), (None, "null id " + prose(30)), (7, "word " * 30_000), (8, "\x00[/INST] <s> ퟿"), (9, "Å" * 5000)]


# --- decontamination ----------------------------------------------------------------------------------------------------------


def brute_decontaminate(docs, items, window=13):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    pats = defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            pats[tuple(w[k : k + window])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = low(t), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in pats:
                    hit |= set(range(k, k + n))
                    ids |= pats[p]
        out.append((d, len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("block", [2_000_000, 120])
def test_decontaminate_brute_force(spark, block):
    rng = random.Random(2)
    items = [(i, prose(n, rng)) for i, n in enumerate([30, 13, 12, 5, 1, 0, 40])] + [(9, None), (10, "Quite unlike!"), (11, prose(400, rng)), (12, "alpha beta"), (13, "Alpha, BETA")]
    docs = [(i, prose(rng.randint(0, 60), rng) + " " + (items[i % 3][1].upper() if i % 3 else "")) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, docs), bench, block_bytes=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got) == sorted(brute_decontaminate(docs, items))


def test_decontaminate_odd(spark):
    bench = spark.createDataFrame([(1, "one"), (1, "one"), (None, "null id"), (3, "")], "item_id long, text string")
    rows = decontaminate.decontaminate(frame(spark, ODD), bench).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[4].n_hit == 1 and by[4].item_ids == ["1"] and by[4].contaminated and by[1].n_words == 0 and not by[1].contaminated
    assert by[None].n_hit >= 2 and by[None].n_items == 0
    assert decontaminate.decontaminate(frame(spark, ODD).limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(frame(spark, ODD), bench.limit(0)).collect())


# --- near duplicates ------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng.randint(0, 200), rng)) for i in range(80)]
    docs += [(100 + i, re.sub("alpha", "omega", t, count=1)) for i, t in docs[:40]] + [(200, docs[3][1]), (201, None), (202, "")]
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    fps = {d: brute_fingerprint(t) for d, t in docs}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)


@pytest.mark.parametrize("block", [2048, 8])
def test_links_find_chains_and_large_keys(spark, block):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {}
    for k, b in enumerate(base):
        for _ in range(60):
            b ^= sum(1 << x for x in rng.sample(range(64), rng.randint(1, 4)))
            fps[len(fps) + 1000 * k] = b
        for _ in range(40):
            fps[len(fps) + 1000 * k] = base[k] ^ sum(1 << x for x in rng.sample(range(12), 2))
    distinct = {v: k for k, v in sorted(fps.items(), reverse=True)}
    nodes = spark.createDataFrame([(k, simhash._signed(v)) for v, k in distinct.items()], "node long, fp long")
    table = simhash.pivot_table(nodes)
    row = table.first()
    assert list(np.array([row[f"p{i}"] for i in range(3)], np.int64).view(np.int8)) == [(row.fp % (1 << 64) ^ p).bit_count() for p in simhash.pivots()]
    found = {r.node: r.component for r in common.components(simhash.links(table, block=block)).collect()}
    want = brute_components({k: v for v, k in distinct.items()})
    assert {k: found.get(k, k) for k in want} == want


def test_large_keys_are_taken_apart(spark):
    rng = random.Random(5)
    nodes = [(i, 5 | rng.getrandbits(33) << 30) for i in range(2000)]  # one key of two bands, wide apart in the others
    rows = simhash.keyed(simhash.pivot_table(spark.createDataFrame(nodes, "node long, fp long")), block=300)
    sizes = rows.groupBy("mask", "bits", "lo", "hi").count().agg(F.max("count"), F.sum("count"), F.max("hi")).first()
    assert sizes[0] <= 300 and sizes[1] <= 2000 * (10 + 3) and sizes[2] == 0
    for m in simhash.band_masks():
        parts = simhash.finer(m)
        assert len(parts) == 4 and all(p & m == m for p in parts) and parts[0] | parts[1] | parts[2] | parts[3] == (1 << 64) - 1
        assert sum((p ^ m).bit_count() for p in parts) == 64 - m.bit_count()


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(5, 5), (None, 3), (1000, 1001)], "a long, b long"))
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert common.components(edges.limit(0)).count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(21)
    base = prose(400, rng).split()
    near = " ".join([*base[:200], "changed", *base[201:]])
    assert 0 < (brute_fingerprint(" ".join(base)) ^ brute_fingerprint(near)).bit_count() <= 3
    docs = [(1, " ".join(base)), (5, near), (5, "quite another text " * 5), (9, "and one more of them " * 5), (None, "and one more of them " * 5)]
    found = simhash.near_duplicates(frame(spark, docs))
    assert sorted((r.doc_id or 0, r.component_id) for r in found.collect()) == [(0, 9), (1, 1), (5, 1), (5, 5), (9, 9)]
    gone = {(r.doc_id, r.text_hash) for r in simhash.duplicates(found).collect()}
    hashes = dict(spark.createDataFrame(docs, "d long, t string").select("t", simhash.text_hash(F.col("t"))).collect())
    assert gone == {(5, hashes[near]), (None, hashes[docs[4][1]])}


def test_simhash_odd(spark):
    rows = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {by[i][0].fp for i in (1, 2, 3)} == {0} and {by[i][0].component_id for i in (1, 2, 3)} == {1}
    assert by[None][0].component_id is None
    assert simhash.near_duplicates(frame(spark, ODD).limit(0)).count() == 0


# --- tokens ---------------------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    enc = Encoder(default_path())
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Z é\n\t.,'s!  1²ªµ\xa0ß$#\x85\x1c\r|<>’中") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab Zé\n.,'st1 ") for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["x <|endoftext|> y", "\n", " ", "a ", "\na", "w" * 3000]
    assert enc.many(texts) == [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def expected_ids(docs, end):
    enc = Encoder(default_path())
    return [(d, enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in docs]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_records_round_trip(spark, tmp_path):
    docs = [(50 - i, prose(i * 7)) for i in range(50)] + [(60, None), (61, "")]
    path = f"file://{tmp_path}/r"
    records.write(frame(spark, docs).repartition(7), path)
    got = sorted(r[:] for r in records.read(spark, path).collect())
    at, want = 0, []
    for d, ids in sorted(expected_ids(docs, 2)):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    shuffled = records.read_shuffled(spark, path, 3).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in shuffled) == sorted(expected_ids(docs, 2)) and [r.doc_id for r in shuffled] != sorted(r.doc_id for r in shuffled)
    assert [r.doc_id for r in records.read_shuffled(spark, path, 4).collect()] != [r.doc_id for r in shuffled]


def test_files_are_ordered_by_number_and_equal_rows_split(spark, tmp_path, monkeypatch):
    names = [f"part-{k:05d}-u-c{c:03d}.txt" for k in (0, 9, 99_999, 100_000) for c in (0, 2, 1000)]
    rows = spark.createDataFrame([(n,) for n in names], "file string").repartition(3)
    assert [r.file for r in rows.orderBy(*records.place("file")).collect()] == names
    path = f"file://{tmp_path}/same"
    docs = spark.createDataFrame([(7, "one and the same text")] * 400, "doc_id long, text string").repartition(2)
    assert records._parts(docs) == 4  # an unknown size
    docs.write.parquet(f"{path}-docs")
    docs = spark.read.parquet(f"{path}-docs")
    monkeypatch.setattr(records, "FILE_BYTES", 200)
    assert records._parts(docs) > 4
    records.write(docs, path)
    assert records.index(spark, path).groupBy("file").count().agg(F.max("count")).first()[0] < 300
    ends = sorted((r.start, r.n_tokens) for r in records.read(spark, path).collect())
    assert len(ends) == 400 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_records_odd(spark, tmp_path):
    odd = [(d, t) for d, t in ODD]
    records.write(frame(spark, odd), f"file://{tmp_path}/a")
    rows = records.read(spark, f"file://{tmp_path}/a").collect()
    assert len(rows) == len(odd) and sorted(r.start for r in rows)[0] == 0
    ends = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert min(rows, key=lambda r: r.start).doc_id is None
    records.write(frame(spark, odd).limit(0), f"file://{tmp_path}/b")
    assert records.read(spark, f"file://{tmp_path}/b").count() == 0


def test_damage_is_found():
    data = records.frame(7, np.array([1, 2, 70_000], "<u4")) + b"\n" + records.frame(None, np.array([5], "<u4"))
    assert [(i, a.tolist()) for i, a in (records.parsed(p) for _, _, p in records.frames(data))] == [(7, [1, 2, 70_000]), (None, [5])]
    for at in (0, 9, 20, len(data) - 2):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            list(records.frames(bytes(bad)))


# --- packing --------------------------------------------------------------------------------------------------------------------


def checked_packing(rows, docs, capacity, end=0):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for d, ids in expected_ids(docs, end):
        at = 0
        own = sorted(pieces[d], key=lambda r: r.piece)
        for k, r in enumerate(own):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length])) and (k == 0 or r.length == capacity)
            at += r.length
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= capacity)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    docs = [(i, prose(RNG.randint(0, 900))) for i in range(150)] + [(900, None), (901, "x " * 5000)]
    rows = packing.best_fit_sequences(frame(spark, docs), 2048).collect()
    n = checked_packing(rows, docs, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_merges_parts(spark):
    items = spark.range(3000).selectExpr("id", "cast(1 + pmod(hash(id), 900) as bigint) as length")
    rows = packing.pack(items, part_rows=100, fan_in=3).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and max(a + n for a, n in own) <= 2048
    assert len(rows) == 3000 and len(bins) <= 1.03 * sum(r.length for r in rows) / 2048


def test_cut_and_best_fit():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]
    placed, fill = packing.best_fit([5, 5, 3, 3, 2, 2], 10)
    assert sorted(fill) == [10, 10] and len(placed) == 6
    assert packing.handed_up([10, 4, 7, 6, 9], 10, 2) == [1, 3, 2]


def test_packing_odd(spark):
    assert packing.best_fit_sequences(frame(spark, ODD).limit(0)).count() == 0
    rows = packing.best_fit_sequences(frame(spark, ODD), with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(i) for _, i in expected_ids(ODD, 0)) and all(len(r.ids) == 4 * r.length for r in rows)


# --- toxicity -------------------------------------------------------------------------------------------------------------------


def toxic_tables(spark, n=500):
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("ona", "iri", "umo", "ela", "atto")]
    bad = ["vile", "rotten", "grimfolk", "grimfolken", "nasty"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs += [(n + i, docs[0][1]) for i in range(40)]
    labels += [(n + i, 1, 1) for i in range(40)]
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_tables(spark)
    rows = toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = {d: t for d, _, t in labels}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 3 == 1}
    assert all(r.predicted == want[r.doc_id] for r in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = toxic_tables(spark, 200)
    flipped = [(d, q, 1 - t) if zlib.crc32(str(d).encode()) % 3 == 1 else (d, q, t) for d, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    a = toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, kind)).collect()
    b = toxicity.toxicity(frame(spark, docs), spark.createDataFrame(flipped, kind)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.toxicity(frame(spark, ODD), known).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(frame(spark, ODD).limit(0), labels).count() == 0


def test_lexicon_takes_rare_entries_at_any_number_of_toxic_rows():
    found = [np.array([0])] * 1996 + [np.array([1])] * 4 + [np.array([2])] * 2 + [np.array([3, 4])] * 4
    assert toxicity.greedy([("wcommon", 0), ("wrare", 0), ("wchance", 0), ("wgrimfolken", 0), ("4grim", 0)], found, [1.0] * 2006) == ["wcommon", "wrare", "4grim"]


def test_label_model_weighs_correlated_voters_down():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    noisy = lambda p: np.where(rng.random(2000) < p, y, ~y).astype(np.int8)
    same = noisy(0.7)
    q, weight = toxicity.label_model(np.stack([same, same, same, noisy(0.85), noisy(0.85), noisy(0.85)], axis=1))
    assert weight[:3].max() < weight[3:].min() and ((q > 0.5) == y).mean() > 0.9


# --- substrings -----------------------------------------------------------------------------------------------------------------


def brute_substring(docs, window=20):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("bits", [1 << 27, 1 << 20])
def test_substring_brute_force(spark, bits):
    rng = random.Random(8)
    many = [f"w{i}" for i in range(3000)]
    passage, phrase = prose(70, rng, many), prose(22, rng, many)
    docs = []
    for i in range(120):
        t = prose(rng.randint(0, 90), rng, many)
        if i % 3 == 0:
            t += " " + passage
        if i % 4 == 0:
            w = passage.split()
            w[rng.randrange(70)] = "edit"
            t = " ".join(w) + "\n" + t
        if i % 2:
            t += "\t" + phrase + " " + prose(5, rng, many)
        docs.append((i, t))
    docs += [(200, "a " * 100), (201, "a b " * 60), (202, docs[3][1]), (203, docs[3][1]), (204, None), (205, prose(19, rng, many)), (206, prose(80, rng, ["of", "the"]))]
    rng.shuffle(docs)
    got = substring.substring_dedup(frame(spark, docs).repartition(5), bits=bits).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_substring(docs)


def test_substring_odd(spark):
    rows = substring.substring_dedup(frame(spark, ODD)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[1].n_words == 0 and by[1].kept == "" and by[4].kept == "one"
    assert (by[7].n_words, by[7].n_removed, by[7].kept) == (30_000, 29_999, "word")
    assert substring.substring_dedup(frame(spark, ODD).limit(0)).count() == 0
    long = prose(40, random.Random(1), [f"w{i}" for i in range(500)])
    shared = [(5, long), (5, "other words " + long), (6, long), (None, long), (None, "x " + long), (None, prose(30))]
    left = substring.substring_dedup(frame(spark, shared * 2).repartition(3)).collect()
    assert sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in left) == sorted([(5, 40, 0), (5, 42, 0), (6, 40, 40), (99, 40, 40), (99, 41, 40), (99, 30, 0)] * 2)
    kept = substring.deduplicated(frame(spark, [(1, "a  b"), (2, None)]))
    assert kept.columns == frame(spark, []).columns and {r.doc_id: r.text for r in kept.collect()} == {1: "a  b", 2: None}


def test_edges_of_one_task_join_like_those_of_many(spark, monkeypatch):
    rng = random.Random(18)
    words = ["a"] * 30 + ["b"]
    docs = [(rng.randint(0, 12), prose(rng.randint(20, 60), rng, words)) for _ in range(60)]
    want = None
    for held, parts in ((1_000_000, 1), (50, 1), (1_000_000, 7), (50, 7)):
        monkeypatch.setattr(substring, "HELD", held)
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect())
        want = want or got
        assert got == want
    assert any(r[2] for r in want)


def test_spans_name_their_sources(spark):
    words = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(words[:100])), (2, " ".join(words[10:60] + ["x"] + words[120:160])), (3, " ".join(["y", *words[120:150], *words[20:80]]))]
    rows = spark.createDataFrame(docs, "id long, text string").withColumn("t", F.lit(0).cast("long"))
    got = sorted(r[:] for r in substring.spans(rows.select("id", "t", "text")).select("id", "at", "n", "id0", "at0").collect())
    assert got == [(2, 0, 31, 1, 10), (3, 1, 11, 2, 51), (3, 31, 41, 1, 20)]


def test_word_hashes_tell_words_apart():
    words = [b"a", b"aa", b"ab", b"ba", b"abcdefgh", b"abcdefghi", b"abcdefgi", b"x" * 600, b"x" * 601, b"\xc5\x82"]
    data = b" " + b" ".join(words) + b" 12345678"
    sizes = np.array([len(w) for w in words])
    starts = 1 + np.cumsum(sizes + 1) - sizes - 1
    a, b = common.word_hashes(data, starts, sizes)
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(words)
    again, _ = common.word_hashes(b"??" + data, starts + 2, sizes)
    assert again.tolist() == a.tolist()


# --- quality --------------------------------------------------------------------------------------------------------------------


def brute_kneser_ney(texts):
    """ln P of each 4-gram's last character, by interpolated modified Kneser-Ney, in plain dictionaries."""
    counts = defaultdict(int)
    for t in texts:
        for g in t:
            counts[g] += 1
    level = {4: dict(counts)}
    for k in (3, 2, 1):
        level[k] = defaultdict(int)
        for g in level[k + 1]:
            level[k][g[1:]] += 1
    off, totals = {}, {}
    for k, own in level.items():
        n = {j: max(1, sum(c == j for c in own.values())) for j in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2])
        off[k] = {j: max(0.05, min(j - 0.05, j - (j + 1) * y * n[j + 1] / n[j])) for j in (1, 2, 3)}
        totals[k] = defaultdict(list)
        for g, c in own.items():
            totals[k][g[:-1]].append(c)

    def chance(g):
        k = len(g)
        if not k:
            return 1 / quality.UNICODE
        below, seen = chance(g[1:]), totals[k].get(g[:-1])
        if not seen:
            return below
        c = level[k].get(g, 0)
        return (c - (off[k][min(c, 3)] if c else 0)) / sum(seen) + sum(off[k][min(x, 3)] for x in seen) / sum(seen) * below

    return lambda t: sum(-np.log(chance(g)) for g in t)


def four_grams(text):
    """Those of a text's characters, and one for each word that says whether it repeats the word before."""
    low, again, fresh = quality.written(text)
    spelled, fill = f"   {low} " if low else "", chr(quality.FILL) * 3
    return [spelled[i : i + 4] for i in range(len(spelled) - 3)] + [fill + chr(quality.AGAIN)] * again + [fill + chr(quality.FRESH)] * fresh


def test_quality_equals_a_plain_model(spark):
    rng = random.Random(14)
    vocab = VOCAB + ["ящик", "中文"]
    docs = [(i, prose(rng.randint(0, 60), rng, vocab), "ab"[i % 2]) for i in range(240)] + [(900, "the the the", "a"), (901, None, "b"), (902, "zzz", "c")]
    labels = [(d, 1) for d, _, _ in docs[:150]]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = {r.id for r in spark.range(150).filter(quality._held()).collect()}
    read, symbols = four_grams, lambda t: len(four_grams(t))
    for lang, model in (("a", "a"), ("b", "b"), ("c", "ab")):
        own = [(d, t) for d, t, x in docs if d < 150 and x in model]
        surprise = brute_kneser_ney([read(t) for d, t in own if d not in held])
        kept = [(d, t) for d, t in own if d in held]
        mean = sum(surprise(read(t)) for _, t in kept) / max(1, sum(symbols(t) for _, t in kept))
        worth = lambda t: np.exp((surprise(read(t)) + quality.PRIOR * mean) / (symbols(t) + quality.PRIOR))  # noqa: E731, B023
        limit = sorted(worth(t) for _, t in kept)[int(np.ceil(quality.QUANTILE * len(kept))) - 1] * (1 + quality.SLACK / len(kept))
        for d, t, x in docs:
            if x == lang:
                assert got[d].n_symbols == symbols(t) and abs(got[d].perplexity / worth(t) - 1) < 1e-4 and abs(got[d].threshold / limit - 1) < 1e-4
                assert got[d].keep == (got[d].perplexity <= got[d].threshold or not symbols(t))
    assert quality.written(" The the\n the The cat ") == ("the cat", 3, 2) and quality.written("\ue000 x\ue001") == ("\ufffd x\ufffd", 0, 2)
    assert quality.written(None) == quality.written(" ") == ("", 0, 0)


def test_quality_keeps_clean_and_drops_noise(spark):
    rng = random.Random(9)
    good = [(i, prose(rng.randint(20, 120), rng)) for i in range(300)]
    noise = [(1000 + i, "".join(rng.choice("#$%&qxzj@ ") for _ in range(300))) for i in range(20)]
    noise += [(1100 + i, " ".join(f"{w} " * 20 for w in rng.sample(VOCAB, 4))) for i in range(20)]
    docs = spark.createDataFrame([(d, t, ["en", "de", None][d % 3]) for d, t in good + noise], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, _ in good if d < 200], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert not any(rows[d].keep for d, _ in noise) and sum(rows[d].keep for d, _ in good) >= 285


def test_quality_odd(spark):
    docs = frame(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(5, 1), (None, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality.quality(docs, known).collect()
        assert len(rows) == len(ODD) and all(r.keep for r in rows if r.n_symbols == 0)
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_quality_any_script_and_any_number_of_languages(spark):
    rng = random.Random(10)
    scripts = ["абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρστ", "ابتثجحخدذرزسشصض", "的一是不了人我在有他这中大来上国和说们为"]
    good, noise = [], []
    for k in range(20):
        words = ["".join(rng.choice(scripts[k % 4]) for _ in range(rng.randint(2, 6))) for _ in range(12)]
        good += [(1000 * k + i, prose(rng.randint(60, 90), rng, words), f"l{k}") for i in range(40)]
        letters = "".join(words)
        noise += [(1000 * k + 500, " ".join("".join(rng.choice(letters) for _ in w) for w in prose(80, rng, words).split()), f"l{k}")]
    docs = spark.createDataFrame(good + noise, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, _, _ in good], "doc_id long, quality int")
    rows = quality.quality(docs, labels).collect()
    assert sum(r.keep for r in rows if r.doc_id % 1000 == 500) == 0
    assert sum(r.keep for r in rows if r.doc_id % 1000 != 500) >= 0.9 * len(good)
    assert len({(r.lang, r.threshold) for r in rows}) == len({r.threshold for r in rows}) == 20


def test_quality_model_sums_to_one(spark):
    text = prose(300, random.Random(3), ["ab", "ba", "ящ", "a"])
    rows = spark.createDataFrame([(text, "x")], "text string, lang string")
    table = {(r.p, r.q): (r.alpha or 0, 1 if r.gamma is None else r.gamma) for r in quality.model(quality.counted(rows, {"x": 0}, False)).collect()}
    rest = quality.UNICODE - sum(p == -1 for p, _ in table if (p, _) != (0, 0) and table[p, _][0])

    def chance(c, context):
        own = 0
        for x in context + c:
            own = own << quality.BITS | ord(x)
        k = len(context) + 1
        key = (own >> 2 * quality.BITS, own & (1 << 2 * quality.BITS) - 1) if k == 4 else (-k, own)
        before = 0
        for x in context:
            before = before << quality.BITS | ord(x)
        gamma = table.get((1 - k, before), (0, 1))[1]
        return table.get(key, (0, 1))[0] + gamma * (chance(c, context[1:]) if context else 1 / quality.UNICODE)

    for context in ("", "a", "a b", " ящ", "zzz"):
        assert abs(sum(chance(c, context) for c in "ab ящ" + chr(quality.AGAIN) + chr(quality.FRESH)) + rest * chance("一", context) - 1) < 1e-9


# --- chat -----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<\\/s> <\\\\/s>", "[[/TURN]", "[TURN", "<<s>>", "[\\/TURN]", "a\\n\\", "<|im_start|>x"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unline(chat.line(text + "\n")) == text + "\n"
    assert not re.search(r"</?s>|\[/?INST\]|\[/?TURN\]|<\|im_start\|>", chat.escape(text))
    shown = "".join(t for t, _ in chat.segments(chat.compiled(), iter([{"role": text, "content": text}, {"role": "assistant", "content": text}])))
    assert list(chat.parse_turns(shown)) == [(text, text), ("assistant", text)]


def test_template_language():
    show = lambda t, **env: "".join(p[0] for p in chat.compiled(t)(env) if p)
    assert show("{% for m in xs %}{{ loop.index }}{% if loop.first %}a{% elif loop.last %}z{% else %}-{% endif %}{{ m['x'] | upper }}{% endfor %}", xs=[{"x": "p"}, {"x": "q"}, {"x": "r"}]) == "1aP2-Q3zR"
    assert show("{% set a = 'x' + 'y' %}{{ a }}{% if not a == 'xy' or b %}no{% endif %}", b="") == "xy"
    assert chat.folded(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == [("text", "abcd")]
    for bad in ("{% for %}", "{% if x %}", "{{ x | eval }}", "{{ f() }}", "{{ 'a }}", "{% nope %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    with pytest.raises(chat.TemplateError):
        show("{{ x.__class__ }}", x="s")
    masked = [p for p in chat.compiled("a{% generation %}b{% endgeneration %}c")({}) if p]
    assert masked == [("a", False), ("b", True), ("c", False)]


def test_chat_round_trip(spark):
    rng = random.Random(10)
    bits = ["</s>", "[INST]", "\\", "\n", "x", "<", "[", "é😀", "[/TURN]", " "]
    turns = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(9))])) for c in [*range(20), None] for t in range(rng.randint(1, 6))]
    turns += [turns[0], (3, None, "user", "no turn"), (77, 0, "user", "y " * 50_000)]
    df = spark.createDataFrame([(*t, "z", "w") for t in turns], "conv_id long, turn long, role string, text string, seq string, loss string")
    got = {r.conv_id: r for r in chat.read_back(common.stored(chat.format_conversations(df), "t")).collect()}
    by = defaultdict(list)
    for t in turns:
        by[t[0]].append(t[1:])
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    for conv, own in by.items():
        own = sorted(own, key=key)
        all_ = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in own)
        loss = "".join(x or "" for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(all_.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len(by) and chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# --- sharding -------------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark):
    docs = [(i, prose(i % 9) if i % 7 else None) for i in range(1003)] + [(5, "twice"), (5, "twice"), (None, "x"), (None, None)]
    rows = sharding.shard_rows(frame(spark, docs)).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    texts = dict(docs[:1003])
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows if r.doc_id not in (None, 5))
    assert sharding.shard_rows(frame(spark, docs).limit(0)).count() == 0


def brute_ring(keys, shards, nodes=sharding.NODES):
    """A plain walk: cells clockwise, each row to the next node whose shard has room, all rows of a round before the next node."""
    cells, owners = sharding.ring(shards, nodes)
    room = sharding.quotas(len(keys), shards, 0.0)
    waiting = [(c, int(np.searchsorted(cells, c)) % len(owners)) for c in sorted(keys)]
    placed = defaultdict(lambda: defaultdict(int))
    while waiting:
        onward = []
        for cell, node in waiting:
            shard = int(owners[node])
            if room[shard]:
                room[shard] -= 1
                placed[cell][shard] += 1
            else:
                onward.append((cell, (node + 1) % len(owners)))
        waiting = onward
    return placed


@pytest.mark.parametrize("hot_rows", [100_000, 20])
def test_shards_are_those_of_a_plain_walk(spark, hot_rows):
    docs = [(i, prose(i % 5)) for i in range(700)] + [(None, "same")] * 300 + [(3, "twice")] * 40
    df = frame(spark, docs)
    cell = dict(df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - sharding.CELL_BITS).cast("int")).distinct().collect())
    rows = sharding.shard_rows(df, hot_rows=hot_rows).collect()
    got = defaultdict(lambda: defaultdict(int))
    for r in rows:
        got[cell[r.doc_id]][r.shard] += 1
    assert got == brute_ring([cell[d] for d, _ in docs], 16)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_plan_is_the_ring_walked_row_by_row():
    counts = {c: 1 + c % 3 for c in range(0, 65536, 97)}
    runs = sharding.plan(counts, 5, 0.05, nodes=16)
    cells, owners = sharding.ring(5, 16)
    room = dict(enumerate(sharding.quotas(sum(counts.values()), 5, 0.05)))
    taken = defaultdict(int)
    for cell, lo, hi, shard, base in runs:
        assert base == taken[shard]
        taken[shard] += hi - lo
    assert sum(taken.values()) == sum(counts.values()) and all(taken[s] <= room[s] for s in taken)
    home = {c: int(owners[int(np.searchsorted(cells, c)) % len(owners)]) for c in counts}
    moved = sum(hi - lo for cell, lo, hi, shard, _ in runs if shard != home[cell])
    assert all(taken[home[cell]] == room[home[cell]] for cell, _, _, shard, _ in runs if shard != home[cell]) and moved < 0.5 * sum(counts.values())


def test_one_more_shard_moves_little():
    counts = dict.fromkeys(range(65536), 3)
    where = lambda n: {(c, k): s for c, lo, hi, s, _ in sharding.plan(counts, n, 0.1) for k in range(lo, hi)}
    a, b = where(16), where(17)
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)


# --- top k ----------------------------------------------------------------------------------------------------------------------


def brute_top(rows, asks, k=5):
    """rows: (id, vector); asks: positions of those that ask."""
    out = []
    for a in asks:
        q, v = rows[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for n, (i, w) in enumerate(rows) if n != a and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "leaf", "block", "group"), [(4096, 64, 2048, 32), (40, 4, 3, 2)])
def test_top_k(spark, shard, leaf, block, group):
    rng = random.Random(12)
    raw = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    raw += [(1000 + i, raw[7][1]) for i in range(60)] + [(2000, [0.5] * 3), (2050, [0.25] * 3), (2100, []), (50, raw[50][1]), (100, raw[7][1])]
    bad = [(3000, None), (3050, [1.0, None]), (3100, [float("nan")] * 6), (3150, [float("inf")] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 7, 0.5) for r in raw + bad], "vec_id long, embedding array<double>, v string, dim int, score double")
    rows = topk.integers(df)
    vectors = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in raw]
    got = topk.top_k(rows, rows.filter("vec_id % 50 = 0"), shard_rows=shard, leaf=leaf, block=block, group=group).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(vectors, [n for n, (i, _) in enumerate(vectors) if i % 50 == 0])


def test_top_k_large_components_and_empty(spark):
    big = {0: [3e7, 1.0], 1: [3e7, 2.0], 2: [3e7, 3.0], 3: [-3e7, 0.0], 4: [1e6, 0.0]}
    rows = topk.integers(spark.createDataFrame(list(big.items()), "vec_id long, embedding array<double>"))
    got = topk.top_k(rows, rows.filter("vec_id = 0"), shard_rows=2).collect()
    least, most = -(1 << 63), (1 << 63) - 1
    want = [(i, max(least, min(most, s))) for _, _, i, s in brute_top([(i, [int(256 * x) for x in v]) for i, v in big.items()], [0])]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == want == [(2, most), (1, most), (4, 256**2 * 3 * 10**13), (3, least)]
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0 and topk.top_k(rows, rows.limit(0)).count() == 0


def test_trees_cover_their_points():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (500, 4))
    tree = topk.Tree(np.arange(500), rows, 16)
    q = rng.integers(-50, 50, (1, 4))
    bounds = tree.bounds(q)[0]
    for k, (a, b, left, right) in enumerate(tree.nodes):
        assert (tree.rows[a:b] @ q[0]).max() <= bounds[k] and tree.least[k] == tree.ids[a:b].min() and (left < 0) == (right < 0)
    assert sorted(tree.ids.tolist()) == list(range(500))
